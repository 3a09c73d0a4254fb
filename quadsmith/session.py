"""The shared folder: where lineage is cut and tables that several queries use are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, as in tests, a new temporary folder."""
    jsc = spark.sparkContext._jsc.sc()
    named, have = spark.conf.get("spark.checkpoint.dir", None), jsc.getCheckpointDir()
    if named is None and have.isDefined():
        return have.get()
    if named is None:
        named = f"file://{tempfile.mkdtemp(prefix='quadsmith-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if not have.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_dir(spark: SparkSession) -> str:
    """A new folder, not yet made, which all executors see."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

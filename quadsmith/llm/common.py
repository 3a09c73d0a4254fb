"""What the operators share: reading the tables, Arrow batches in and out, the shared folder, the tokenizer files."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, shared_dir, written

__all__ = ["KEPT", "LISTS_BY_SORT", "SHUFFLES_DELETED", "bounded", "checkpoint_dir", "give_back", "keep_pages", "map_batches", "release", "settings", "shared_dir", "table", "tokenizer_file", "trim", "written"]
TOKENIZERS = "/opt/tokenizers"


pa.set_memory_pool(pa.system_memory_pool())  # so that trim() can give Arrow's memory back too


def trim() -> None:
    """Give freed memory back to the system, where the C library can: a worker process lives on between tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Bytes of rows that go to a Python worker at once; Spark's own limit lets a batch be as large as a whole partition.
BATCH_LIMIT = "1m"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes too (where the session says nothing about that)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_LIMIT)
    return df


def keep_pages() -> None:
    """Let freed arrays serve the next ones, until trim(): arrays mapped one by one cost more in page faults than in work."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # from this size on an array is mapped by itself
        libc.mallopt(-1, 64 << 20)  # so much may lie free at the heap's end
    except (OSError, AttributeError):
        pass


def give_back(spark: SparkSession) -> None:
    """Let the executors' JVMs return the heap that earlier work left behind: they keep what they once took until collected."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (names with _ for .) are these inside, and afterwards what they were."""
    values = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: What is made and run under it deletes its shuffle files as soon as it has ended, not when the driver next collects.
SHUFFLES_DELETED = {"spark_sql_classic_shuffleDependency_fileCleanup_enabled": "true"}
#: Lists are collected from sorted rows, which need no table of groups.
LISTS_BY_SORT = {"spark_sql_execution_useObjectHashAggregateExec": "false"}


#: What a worker process keeps from task to task, by the kind of task.
KEPT: dict[str, object] = {}


def release(kind: str | None = None) -> None:
    """Forget what tasks of other kinds kept in this worker, which may serve any task."""
    keep_pages()
    gone = [k for k in KEPT if k != kind]
    for k in gone:
        del KEPT[k]
    trim()


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, kind: str | None = None) -> DataFrame:
    """mapInArrow where fn turns one batch into one dict, or several dicts, of column values (arrays or lists)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(kind)
        for batch in batches:
            made = fn(batch)
            for part in [made] if isinstance(made, dict) else made:
                cols = [x.cast(f.type) if isinstance(x := part[f.name], pa.Array) else pa.array(x, type=f.type, from_pandas=True) for f in out]
                yield pa.RecordBatch.from_arrays(cols, schema=out)
            trim()

    return bounded(df).mapInArrow(run, schema)


def tokenizer_file(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)

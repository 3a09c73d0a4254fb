"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Language ID drops documents in no language and sets `lang`; near-dedup keeps one document of each class; substring
dedup takes repeated word sequences out of the texts; secrets are replaced by a mark; what is left is packed into
sequences. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadsmith.llm import anchors, language, packing, secrets, simhash
from quadsmith.llm.common import table, written


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs, language.fit_unheld(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(anchors.deduplicated(docs))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_redaction", secret_redaction),
    ("packing", pack),
]
ORACLE_SQL = None  # SQL can't express the stages; tests/llm holds each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of the documents table."""
    docs = table(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs

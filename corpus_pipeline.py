"""A cleaning pipeline for training text: quality rules, near-dedup, substring dedup, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and read again before the next. All stages but the last return the columns
of documents; n_chars follows the text.

Defined results: a stage takes documents with null ids, texts, languages or sources, empty and
very long texts, repeated rows, other columns of any name and empty tables; null texts have no
words, so the quality rules drop them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, packing, quality, secrets, simhash, substrings
from millrace.llm.queries import END_OF_TEXT, PACKING_RANKS, vocabulary


def counted(docs: DataFrame) -> DataFrame:
    """n_chars of a text that has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(substrings.removed(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *vocabulary(PACKING_RANKS), END_OF_TEXT)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("pack", pack)]

#: Near-dedup's hashes and the packing's tokens can't be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself goes when its result is written, and that goes
    when the next one's is; the result of the last stage but one stays for the rows to be read."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with common.scratch(spark):
            docs = common.stored(stage(spark, docs, sf_dir), name, lasting=True)
        if before is not None:
            common.release(spark, before)
        before = docs
    return docs

"""The ten operators as queries with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, fingerprints, packing, quality, secrets, sharding, simhash, substrings, toxicity, urlfilter
from millrace.llm.common import table

PACKING_RANKS, ENCODING_RANKS = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
#: The id of <|endoftext|> in byte_bpe_50k.json.
END_OF_TEXT = 50256


def vocabulary(name: str) -> tuple[str, str]:
    """Path and splitting pattern of an installed vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.FENCES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary(PACKING_RANKS), END_OF_TEXT)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_successor(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary(ENCODING_RANKS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(urlfilter.LIST, None)
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.listed(spark, path) if path else None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_quality, op3_packing, op4_substrings, op5_fingerprints, op6_simhash, op7_sharding, op8_bpe, op9_toxicity, op10_urls)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": quality.sql(), "op4_substrings": substrings.sql(), "op7_sharding": sharding.sql(), "op10_urls": urlfilter.sql()}

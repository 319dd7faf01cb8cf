"""Measures of a corpus: integrity, volumes, signals, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import dot


def state_counts(issues: DataFrame, column: str = "state_reason") -> DataFrame:
    return issues.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def integrity(children: DataFrame, parents: DataFrame, key: str, parent_key: str, bounded: str) -> DataFrame:
    """Orphans, null keys, and bounds of a column, one row."""
    orphans = children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    own = children.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.min(bounded).alias("least"), F.max(bounded).alias("most"))
    return own.withColumn("orphans", F.lit(orphans.first()[0]).cast("long"))


def missing(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids without a vector, to be encoded yet."""
    return ids.join(vectors, "id", "left_anti")


def volume(texts: DataFrame, before: Column, after: Column) -> DataFrame:
    """Mean, median and total length before and after cleaning, and the share left unchanged."""
    rows = texts.select(F.length(before).alias("b"), F.length(after).alias("a"), (before == after).cast("int").alias("same"))
    m = lambda c: F.round(F.avg(c), 4)
    return rows.agg(m("b").alias("mean_before"), F.percentile("b", 0.5).alias("median_before"), F.sum("b").alias("total_before"), m("a").alias("mean_after"), F.percentile("a", 0.5).alias("median_after"), F.sum("a").alias("total_after"), F.round(100 * F.avg("same"), 4).alias("percent_unchanged"))


#: Patterns of text signals; ASCII classes, so that engines agree.
SIGNALS = (("paths", r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"), ("code_fences", "```"), ("versions", r"[0-9]+\.[0-9]+(\.[0-9]+)?"), ("stack_frames", r"at [A-Za-z0-9_.]+ ?\("), ("symbols", r"[#$%&*]{3}"))


def signals(texts: DataFrame) -> DataFrame:
    """Share of texts with each signal."""
    return texts.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col("text").rlike(p).cast("int")), 6).alias(name) for name, p in SIGNALS])


def agreement(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """How often both sides of a pair bear the same label, by the duplicate's label. labels: id, label."""
    a, b = labels.select(F.col("id").alias("duplicate"), F.col("label").alias("label")), labels.select(F.col("id").alias("canonical"), F.col("label").alias("c_label"))
    return pairs.join(a, "duplicate").join(b, "canonical").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("c_label")).alias("same"))


def truncated(issues: DataFrame) -> DataFrame:
    """Threads of which not all comments were fetched."""
    return issues.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("comment_count") > F.col("comments_fetched")).alias("truncated"))


def model_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean, least and greatest cosine of two models' vectors of the same rows. Each: id, vec."""
    s = F.round(dot(F.col("vec"), F.col("vec_b")), 6)
    return a.join(b.withColumnRenamed("vec", "vec_b"), "id").select(s.alias("s")).agg(F.count("s").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"))


def per_year(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.year(column).alias("year")).agg(F.count(F.lit(1)).alias("n"))

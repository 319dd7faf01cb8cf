"""Training data from pairs: positives, hard negatives, rerank tasks, hold-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.retrieve import dense_topk
from millrace.operators.scratch import stored

LEAST_CHARS, BAND_LOW, BAND_HIGH, PER_ANCHOR, HOLD_OUT = 20, 5, 60, 3, 150


def training_pairs(pairs: DataFrame, texts: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(duplicate, canonical, a, p): both texts of at least `least` characters. texts: id, text."""
    side = lambda key, name: texts.select(F.col("id").alias(key), F.col("text").alias(name)).where(F.length(name) >= least)
    return pairs.select("duplicate", "canonical").join(side("duplicate", "a"), "duplicate").join(side("canonical", "p"), "canonical").select("duplicate", "canonical", "a", "p")


def text_marks(texts: DataFrame, least: int) -> DataFrame:
    """(id, mark) of the texts of at least `least` characters: a SHA-256 of the text, stored."""
    return stored(texts.select("id", F.when(F.length("text") >= least, F.unhex(F.sha2("text", 256))).alias("mark")), "marks").where("mark is not null")


def hard_negatives(pairs: DataFrame, all_pairs: DataFrame, corpus: DataFrame, texts: DataFrame, low: int = BAND_LOW, high: int = BAND_HIGH, per_anchor: int = PER_ANCHOR, least: int = LEAST_CHARS) -> DataFrame:
    """(duplicate, canonical, negative, place): of the neighbours of raw ranks low + 1 to high, the
    first per_anchor that are no sibling, canonical or self and whose text differs from both sides.

    Anchors with at most `high` earlier rows are left out: a pool of exactly `high` has no rank to cut at. Texts are gone through
    once and compared by SHA-256; they don't move."""
    marks = text_marks(texts, least)
    of = lambda key, name: marks.select(F.col("id").alias(key), F.col("mark").alias(name))
    anchors = stored(pairs.select("duplicate", "canonical").join(of("duplicate", "a"), "duplicate").join(of("canonical", "p"), "canonical"), "anchors")
    made = corpus.select(F.col("id").alias("query_id"), "vec", F.col("created_at").alias("cutoff"))
    queries = made.join(anchors.select(F.col("duplicate").alias("query_id")).distinct(), "query_id", "left_semi")
    hits = stored(dense_topk(queries, corpus, high + 1), "hits")
    full = hits.groupBy("query_id").agg(F.max("rank").alias("pool")).where(F.col("pool") > high).select("query_id")
    band = hits.join(full, "query_id", "left_semi").where((F.col("rank") > low) & (F.col("rank") <= high)).select(F.col("query_id").alias("duplicate"), F.col("candidate_id").alias("negative"), "rank")
    # A sibling has a canonical of the anchor's: two look-ups by row, where joining siblings would give the square of a family.
    link = all_pairs.select("duplicate", "canonical").distinct()
    of_anchor, of_negative = link.select("duplicate", F.col("canonical").alias("c")), link.select(F.col("duplicate").alias("negative"), F.col("canonical").alias("c"))
    candidates = band.where("duplicate <> negative")
    siblings = candidates.select("duplicate", "negative").join(of_anchor, "duplicate").join(of_negative, ["negative", "c"], "left_semi").select("duplicate", "negative")
    forbidden = siblings.union(link.select("duplicate", F.col("canonical").alias("negative")))
    free = candidates.join(forbidden, ["duplicate", "negative"], "left_anti")
    joined = free.join(anchors, "duplicate").join(of("negative", "n"), "negative").where("n <> p and n <> a")
    order = Window.partitionBy("duplicate", "canonical").orderBy("rank")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_anchor).select("duplicate", "canonical", "negative", "place")


def rerank_task(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One record for each query (q, qt): its candidate ids in rank order. queries: query_id, text."""
    lists = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x.candidate_id).alias("c"))
    return queries.join(lists, "query_id", "left_outer").select(F.col("query_id").alias("q"), F.col("text").alias("qt"), F.coalesce("c", F.array().cast("array<bigint>")).alias("c"))


def task_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The shared texts of a task, each once. texts: id, text."""
    return texts.join(hits.select(F.col("candidate_id").alias("id")).distinct(), "id", "left_semi")


def hold_out(pairs: DataFrame, n: int = HOLD_OUT, seed: int = 0) -> DataFrame:
    """pairs with held_out true for n of them, chosen by a seeded hash."""
    chosen = pairs.select("duplicate", "canonical").orderBy(F.md5(F.concat_ws(":", "duplicate", "canonical", F.lit(seed))), "duplicate", "canonical").limit(n).withColumn("held_out", F.lit(True))
    return pairs.join(chosen, ["duplicate", "canonical"], "left_outer").na.fill(False, ["held_out"])


def triplets(negatives: DataFrame, texts: DataFrame) -> DataFrame:
    """(duplicate, canonical, negative, place, a, p, n): the texts of anchors, positives and negatives. texts: id, text.

    The texts asked for are picked in one pass and stored, a few of all; only these are joined to the three sides."""
    out = stored(negatives, "negatives")
    asked = stored(out.select(F.explode(F.array("duplicate", "canonical", "negative")).alias("id")).distinct(), "asked")
    texts = stored(texts.join(asked, "id", "left_semi"), "texts")
    for key, name in (("duplicate", "a"), ("canonical", "p"), ("negative", "n")):
        out = out.join(texts.select(F.col("id").alias(key), F.col("text").alias(name)), key)
    return out.select("duplicate", "canonical", "negative", "place", "a", "p", "n")

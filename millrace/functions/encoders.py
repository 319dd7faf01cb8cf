"""Where outer models plug in: text encoders and pair scorers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_CHARS, PAIR_CHARS = 2000, 500


def encode(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], done: DataFrame | None = None) -> DataFrame:
    """(id, vec) of texts (id, text) not blank and not in done (id) yet. load() runs once in each
    task and gives a function from texts to vectors."""
    todo = texts.select("id", F.substring("text", 1, TEXT_CHARS).alias("text")).where(F.length(F.trim("text")) > 0)
    todo = todo if done is None else todo.join(done.select("id"), "id", "left_anti")

    def run(frames):
        model = load()
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "vec": model(f["text"].tolist())})

    return todo.mapInPandas(run, "id long, vec array<float>")


def precomputed(ids: DataFrame, vectors: DataFrame, created: DataFrame) -> DataFrame:
    """Queries (query_id, vec, cutoff) from stored vectors; ids without one give no row and so count as missed."""
    made = created.select(F.col("id").alias("query_id"), F.col("created_at").alias("cutoff"))
    return ids.select(F.col("id").alias("query_id")).join(vectors.select(F.col("id").alias("query_id"), "vec"), "query_id").join(made, "query_id")


def score_pairs(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], chars: int = PAIR_CHARS) -> DataFrame:
    """(query_id, candidate_id, score) by a scorer of text pairs; a candidate without text scores as the empty one.
    queries: query_id, text. texts: id, text."""
    score = F.pandas_udf(lambda a, b: scorer(a, b), "double")
    q = queries.select("query_id", F.substring("text", 1, chars).alias("q_text"))
    t = texts.select(F.col("id").alias("candidate_id"), F.substring("text", 1, chars).alias("c_text"))
    pairs = hits.select("query_id", "candidate_id").join(q, "query_id").join(t, "candidate_id", "left_outer")
    return pairs.select("query_id", "candidate_id", score(F.col("q_text"), F.coalesce("c_text", F.lit(""))).alias("score"))

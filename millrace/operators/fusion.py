"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieve import ranked

K, DEPTH = 60, 50


def rrf(lists: list[DataFrame], n: int, k: int = K, digits: int = 9) -> DataFrame:
    """Sum of 1 / (k + rank) over any number of ranked lists, one aggregation."""
    both = reduce(DataFrame.unionByName, [x.select("query_id", "candidate_id", "rank") for x in lists])
    scored = both.groupBy("query_id", "candidate_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score"))
    return ranked(scored, n)

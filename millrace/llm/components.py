"""Connected components of a graph of links, with DataFrames only.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond") alternate until the links stop changing. Every step takes the least neighbour by a
partial aggregation and joins it back, so a node with very many links is never collected in
one place: a sort-merge join may be split by adaptive execution. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common


def star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b."""
    if large:  # every larger neighbour of a node goes to the node's least neighbour or itself
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "u"))
        moved = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the smaller neighbours of a node, and itself, go to the least of them
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = links.join(least, links.a == least.u).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without links have no row.

    links: columns a and b of one orderable type; repeats and loops do no harm."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.stored(ordered, "links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(now)
    while seen[0]:
        now = common.stored(star(star(now, large=True), large=False), "links")
        if (after := state(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Retrieval quality: recall@k, MRR, ceilings, exact significance."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KS = (1, 5, 10)


def canonical_ranks(hits: DataFrame, pairs: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """Each scored pair with the rank of its canonical or null. The query itself is taken out of
    hits after depth was asked for. Pairs whose query is not in known (number) are skipped."""
    order = Window.partitionBy("query_id").orderBy("rank")
    own = hits.where((F.col("candidate_id") != F.col("query_id")) & (F.col("rank") <= depth)).withColumn("place", F.row_number().over(order))
    found = own.select(F.col("query_id").alias("duplicate"), F.col("candidate_id").alias("canonical"), "place")
    return pairs.join(known.select(F.col("number").alias("duplicate")), "duplicate", "left_semi").join(found, ["duplicate", "canonical"], "left_outer")


def metrics(ranks: DataFrame, n_pairs: int | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall_k for each k, mrr, n and skipped; a pair that was not found scores 0."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    recalls = [mean(F.when(F.col("place") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    out = ranks.agg(*recalls, mean(F.coalesce(1.0 / F.col("place"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n"))
    return out if n_pairs is None else out.withColumn("skipped", F.lit(n_pairs) - F.col("n"))


def oracle_hits(pairs: DataFrame) -> DataFrame:
    """A retriever that returns the answer; must score 1."""
    return pairs.select(F.col("duplicate").alias("query_id"), F.col("canonical").alias("candidate_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


def random_hits(pairs: DataFrame, corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n different rows created strictly before each query, or all of them if there are fewer, drawn by a seeded hash.

    corpus: id, created_at; ids may be any. Every row's place in the order of (created_at, id) follows from counts by
    day, so no task sorts them all; places are drawn without replacement (Floyd's way) and joined back to ids.
    A query that is not in corpus gets none."""
    day = F.to_date("created_at")
    days = corpus.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("day").orderBy("created_at")
    placed = corpus.select("id", "created_at", day.alias("day")).join(before, "day")
    placed = placed.select("id", (F.col("before") + F.row_number().over(within.orderBy("created_at", "id")) - 1).alias("place"), (F.col("before") + F.rank().over(within) - 1).alias("earlier"))
    drawn = f"cast(conv(substring(md5(concat_ws(':', query_id, j, {seed})), 1, 12), 16, 10) as long) % (j + 1)"
    floyd = f"aggregate(if(earlier > 0, sequence(greatest(earlier - {n}, 0L), earlier - 1), cast(array() as array<bigint>)), cast(array() as array<bigint>), (s, j) -> array_append(s, if(array_contains(s, {drawn}), j, {drawn})))"
    asked = pairs.select(F.col("duplicate").alias("query_id")).distinct().join(placed.select(F.col("id").alias("query_id"), "earlier"), "query_id")
    draws = asked.select("query_id", F.posexplode(F.expr(floyd)).alias("pos", "place"))
    return draws.join(placed.select(F.col("id").alias("candidate_id"), "place"), "place").select("query_id", "candidate_id", F.lit(0.0).alias("score"), (F.col("pos") + 1).alias("rank"))


def ceiling(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two rankings' canonical_ranks: pairs that both, one or neither found, and the recalls."""
    keys = ["duplicate", "canonical"]
    both = a.select(*keys, F.col("place").isNotNull().alias("x")).join(b.select(*keys, F.col("place").isNotNull().alias("y")), keys, "full_outer").na.fill(False, ["x", "y"])
    n = lambda c: F.count_if(c)
    x, y = F.col("x"), F.col("y")
    share = lambda c: F.round(F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    return both.agg(n(x & y).alias("found_both"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), n(~x & ~y).alias("neither"), share(x).alias("recall_a"), share(y).alias("recall_b"), share(x | y).alias("recall_union"))


def mcnemar_p(gained: int, lost: int) -> float:
    """Exact two-sided binomial p-value over discordant pairs."""
    n = gained + lost
    return float(min(Fraction(1), 2 * Fraction(sum(comb(n, i) for i in range(min(gained, lost) + 1)), 2**n)))


def mcnemar(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """gained (only b hits within k), lost (only a) and p of two canonical_ranks."""
    keys = ["duplicate", "canonical"]
    hit = lambda df, c: df.select(*keys, (F.coalesce(F.col("place"), F.lit(k + 1)) <= k).alias(c))
    counts = hit(a, "x").join(hit(b, "y"), keys).agg(F.count_if(~F.col("x") & F.col("y")).alias("gained"), F.count_if(F.col("x") & ~F.col("y")).alias("lost"))
    return with_p(counts)


def with_p(counts: DataFrame) -> DataFrame:
    """counts (gained, lost) with the exact p-value, rounded to 6 digits. Terms of the binomial
    sum follow from each other by their ratio, in logarithms."""
    step = "acc.log + ln(cast(gained + lost - i + 1 as double)) - ln(cast(i as double))"
    first = "-(gained + lost) * ln(2.0D)"
    places = "if(least(gained, lost) > 0, sequence(1L, cast(least(gained, lost) as bigint)), cast(array() as array<bigint>))"
    total = F.expr(f"aggregate({places}, named_struct('log', {first}, 'sum', exp({first})), (acc, i) -> named_struct('log', {step}, 'sum', acc.sum + exp({step})), acc -> acc.sum)")
    return counts.withColumn("p", F.round(F.least(F.lit(1.0), 2 * total), 6))


def latency(samples: DataFrame, value: str = "value") -> DataFrame:
    """Median, and the element after floor(0.95 n) others of the sorted sample, rounded to 1 digit."""
    rows = samples.where(F.col(value).isNotNull())
    n = rows.count()
    place = (int(0.95 * n) + 0.5) / max(n, 1)
    return rows.agg(F.round(F.percentile(value, 0.5), 1).alias("p50"), F.round(F.expr(f"percentile_disc({place}D) within group (order by {value})"), 1).alias("p95"), F.count(F.lit(1)).alias("n"))


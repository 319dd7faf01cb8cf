import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate, labels

PAIRS = "duplicate long, canonical long"
HITS = "query_id long, candidate_id long, score double, rank int"


def test_oracle_scores_one_and_random_near_none(spark):
    truth = spark.createDataFrame([(i, i - 7) for i in range(100, 400)], PAIRS)
    known = spark.range(400).withColumnRenamed("id", "number")
    r = evaluate.metrics(evaluate.canonical_ranks(evaluate.oracle_hits(truth), truth, known, 10), 300).first()
    assert (r.recall_1, r.recall_5, r.recall_10, r.mrr, r.n, r.skipped) == (1, 1, 1, 1, 300, 0)
    corpus = spark.range(400).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int), 0)").alias("created_at"))
    r = evaluate.metrics(evaluate.canonical_ranks(evaluate.random_hits(truth, corpus, 10), truth, known, 10)).first()
    assert r.recall_10 < 0.2 and r.n == 300


def test_random_draws_earlier_rows_without_repeats(spark):
    """Sparse ids, equal times, several days: each query gets min(10, rows strictly earlier), none twice."""
    made = {i * 10: dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * (i // 3)) for i in range(1, 121)}  # three rows at each time
    corpus = spark.createDataFrame(list(made.items()), "id long, created_at timestamp_ntz")
    truth = spark.createDataFrame([(q, 0) for q in (10, 40, 90, 130, 1200, 999)], PAIRS)
    got, again = ({}, {})
    for out in (got, again):
        for r in evaluate.random_hits(truth, corpus, 10).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.rank, r.candidate_id))
    assert got == again and 999 not in got
    for q in (10, 40, 90, 130, 1200):
        earlier = {i for i in made if made[i] < made[q]}
        own = [c for _, c in got.get(q, [])]
        assert len(own) == len(set(own)) == min(10, len(earlier)) and set(own) <= earlier
        assert [r for r, _ in got.get(q, [])] == list(range(1, len(own) + 1))
    other = {r.candidate_id for r in evaluate.random_hits(truth, corpus, 10, seed=5).where("query_id = 1200").collect()}
    assert other != {c for _, c in got[1200]}


def test_random_draws_are_even(spark):
    corpus = spark.range(20).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(least(id, 19) as int), 0, 0)").alias("created_at"))
    many = spark.range(1000, 1400).select("id", F.lit("2025-01-01").cast("timestamp_ntz").alias("created_at")).union(corpus)
    rows = evaluate.random_hits(spark.range(1000, 1400).select(F.col("id").alias("duplicate"), F.lit(0).alias("canonical")), many, 5).groupBy("candidate_id").count().collect()
    assert len(rows) == 20 and all(60 < r["count"] < 145 for r in rows)  # 100 each on average


def test_self_is_removed_after_the_depth(spark):
    truth = spark.createDataFrame([(5, 1), (6, 1), (7, 2), (8, 3)], PAIRS)
    hits = spark.createDataFrame([(5, 5, 1.0, 1), (5, 1, 0.9, 2), (6, 9, 1.0, 1), (6, 6, 1.0, 2), (6, 1, 1.0, 3)], HITS)
    known = spark.createDataFrame([(5,), (6,), (7,)], "number long")  # 8 has no row: skipped; 7 has no hits: missed
    r = evaluate.metrics(evaluate.canonical_ranks(hits, truth, known, 2), 4, (1, 2)).first()
    assert (r.recall_1, r.recall_2, r.mrr, r.n, r.skipped) == (0.333333, 0.333333, 0.333333, 3, 1)


@pytest.mark.parametrize("gained, lost, p", [(40, 19, 0.0086), (23, 14, 0.1877), (25, 13, 0.0730), (26, 60, 0.0003), (26, 42, 0.0681), (58, 27, 0.0010), (9, 4, 0.2668)])
def test_mcnemar(spark, gained, lost, p):
    assert round(evaluate.mcnemar_p(gained, lost), 4) == p
    assert round(evaluate.with_p(spark.createDataFrame([(gained, lost)], "gained long, lost long")).first().p, 4) == p


def test_mcnemar_without_discordant_pairs(spark):
    assert evaluate.with_p(spark.createDataFrame([(0, 0)], "gained long, lost long")).first().p == 1.0


def test_ceiling(spark):
    rows = lambda x: spark.createDataFrame(x, "duplicate long, canonical long, place int")
    r = evaluate.ceiling(rows([(1, 0, 1), (2, 0, None), (3, 0, 2), (4, 0, None)]), rows([(1, 0, 5), (2, 0, 1), (3, 0, None), (4, 0, None)])).first()
    assert (r.found_both, r.only_a, r.only_b, r.neither, r.recall_union) == (1, 1, 1, 1, 0.75)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_latency(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    r = evaluate.latency(spark.createDataFrame([(v,) for v in values], "value double")).first()
    assert r.p95 == sorted(values)[int(0.95 * n)] and r.n == n


def test_label_vote(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.6, 2), (1, 12, -0.5, 3)], HITS)
    own = spark.createDataFrame([(10, "bug"), (10, "*dup"), (11, "ui, menus"), (11, "bug"), (12, "api"), (10, "spam")], "issue_number long, label string")
    out = [(r.label, r.confidence) for r in labels.knn_vote(hits, own, 2).orderBy("rank").collect()]
    assert out == [("bug", 0.714), ("ui, menus", 0.286)]


def test_label_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "*x"), (4, "a")], "query_id long, label string")
    pred = spark.createDataFrame([(1, "a"), (1, "z"), (2, "y"), (3, "a"), (9, "a")], "query_id long, label string")
    r = labels.label_metrics(pred, gold).first()
    assert (r.issues_scored, r.precision, r.recall, r.f1, r.any_correct) == (3, 0.3333, 0.25, 0.2857, 0.3333)


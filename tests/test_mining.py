import datetime as dt
import random

from millrace.operators import mining
from millrace.plans.adapters import latest_earlier


def test_latest_earlier_joins_no_label_with_itself(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "b", None])) for i in rng.sample(range(400), 150)]
    for span in (7, 1000):
        found = latest_earlier(spark.createDataFrame(rows, "id long, label string"), span)
        want = {i: max((j for j, m in rows if m == k and j < i), default=None) for i, k in rows if k}
        assert {r.id: r.canonical for r in found.collect()} == {i: c for i, c in want.items() if c is not None}


def test_hard_negatives_move_no_texts(spark):
    texts = [(i, f"text number {i % 40} of some length") for i in range(80)] + [(999, "never asked for")]
    texts = spark.createDataFrame(texts, "id long, text string")
    made = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    corpus = spark.createDataFrame([(i, [1.0 - i / 100, 0.0], made(i)) for i in range(80)], "id long, vec array<double>, created_at timestamp_ntz")
    pairs = spark.createDataFrame([(79, 3), (50, 3)], "duplicate long, canonical long")
    out = mining.hard_negatives(pairs, pairs, corpus, texts, low=2, high=20, per_anchor=40)
    # Ranks 3 to 20 are ids 2 to 19, without canonical 3; text 10 equals no side's (50 is 10 again), so 50 passes it over.
    got = {}
    for r in out.orderBy("duplicate", "place").collect():
        got.setdefault(r.duplicate, []).append(r.negative)
    assert got == {79: [2, *range(4, 20)], 50: [2, *[i for i in range(4, 20) if i != 10]]}
    assert "text#" not in out._jdf.queryExecution().executedPlan().toString()


def test_triplets_pick_their_texts_once(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(7, "again")], "id long, text string")
    negatives = spark.createDataFrame([(5, 2, 9, 1), (5, 2, 7, 2), (6, 99, 1, 1)], "duplicate long, canonical long, negative long, place int")
    out = mining.triplets(negatives, texts)
    # A side without a text has no triplet; two texts of one id give two.
    assert sorted(tuple(r) for r in out.collect()) == [(5, 2, 7, 2, "text 5", "text 2", "again"), (5, 2, 7, 2, "text 5", "text 2", "text 7"), (5, 2, 9, 1, "text 5", "text 2", "text 9")]
    # Nothing but the stored tables is left to read: three joins don't go through all texts thrice.
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()

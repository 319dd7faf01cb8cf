"""Search by cells: what moves, and that cells of any number give one result."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieve

DAY = [dt.datetime(2024, 1, i + 1) for i in range(28)]


def rows(df):
    return sorted((r.query_id, r.rank, r.candidate_id, r.score) for r in df.collect())


def bm25(spark, texts, n):
    docs = spark.createDataFrame(texts, "id long, text string, created_at timestamp_ntz")
    tokens = T.tok_words(F.col("text"))
    asked = docs.where("id % 5 = 0").select(F.col("id").alias("query_id"), "text", F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("cutoff"))
    return retrieve.bm25_topk(asked, retrieve.bm25_postings(docs, tokens), tokens, n)


def words(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["all", "a", "b", "c", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 15))), DAY[i % 28]) for i in range(n)]


@pytest.mark.parametrize(("postings", "common", "queries"), [(50, 128, 1024), (10**9, 0, 3), (200, 2, 1)])
def test_bm25_is_the_same_in_any_cells(spark, monkeypatch, postings, common, queries):
    want = rows(bm25(spark, words(3, 120), 7))
    for name, value in (("POSTINGS", postings), ("COMMON", common), ("QUERY_BLOCK", queries)):
        monkeypatch.setattr(retrieve, name, value)
    got = rows(bm25(spark, words(3, 120), 7))
    assert want and [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)


def test_bm25_exchanges_no_pairs(spark):
    """What enters the exchange are the n best of a cell: no join of queries and postings is left."""
    plan = bm25(spark, words(4, 60), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_counts_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "b a b", DAY[0]), (2, "", DAY[0]), (3, None, DAY[0])], "id long, text string, created_at timestamp_ntz")
    counted = retrieve.term_counts(docs, T.tok_words(F.col("text")))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.len, dict(zip(r.token, r.tf))) for r in counted.collect() if r.token is not None} == {1: (3, {"a": 1, "b": 2}), 2: (0, {})} | {r.id: (0, {}) for r in counted.collect() if r.id == 3 and r.token is not None}


def test_queries_stream_past_a_cell(spark, monkeypatch):
    """A task never holds a product of more than QUERY_BLOCK queries, nor of more than SCORES scores."""
    seen = []
    monkeypatch.setattr(retrieve, "SCORES", 64)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 4)
    v = [(i, [float(i % 7), 1.0], DAY[i % 28]) for i in range(100)]
    corpus = spark.createDataFrame(v, "id long, vec array<double>, created_at timestamp_ntz")
    queries = corpus.select(F.col("id").alias("query_id"), "vec", F.col("created_at").alias("cutoff"))
    got = retrieve.dense_topk(queries, corpus, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    for q, rank, c, _ in rows(got):
        seen.append((q, rank, c))
    want = []
    for q in range(100):
        ok = sorted((i for i in range(100) if i % 28 < q % 28), key=lambda i: (-((i % 7) * (q % 7) + 1.0), i))[:3]
        want += [(q, k + 1, c) for k, c in enumerate(ok)]
    assert sorted(seen) == sorted(want)


def long_vectors(spark, rows, length):
    """Queries, corpus and titles of vectors that are made only when a query runs."""
    corpus = spark.range(rows).select("id", F.array_repeat(F.col("id").cast("float"), length).alias("vec"), F.lit(DAY[0]).cast("timestamp_ntz").alias("created_at"))
    return corpus.select(F.col("id").alias("query_id"), "vec", F.lit(None).cast("timestamp_ntz").alias("cutoff")), corpus, corpus.select("id", "vec")


@pytest.mark.parametrize(("search", "most"), [("dense_topk", 1 << 23), ("dense_topk_postfilter", 1 << 23), ("title_weighted_topk", 1 << 22)])
def test_a_cell_is_bounded_in_numbers_not_in_rows(spark, monkeypatch, search, most):
    """A cell of 16,384 vectors of 65,536 numbers would take 8 GB as doubles; 900 of them don't go into one either."""
    made = []
    monkeypatch.setattr(retrieve, "cell_scores", lambda q, c, cells, n, cell, f=retrieve.cell_scores: (made.append(cells), f(q, c, cells, n, cell))[1])
    q, c, t = long_vectors(spark, 900, 65536)
    getattr(retrieve, search)(q, c, *([t] if search.startswith("title") else []), 3)
    assert made and 900 / made[0] * 65536 <= most


def test_cells_of_long_vectors_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = [(i, [round(float(x), 2) for x in rng.normal(size=24)], DAY[i % 28]) for i in range(150)] + [(150, None, DAY[0])]
    corpus = spark.createDataFrame(v, "id long, vec array<float>, created_at timestamp_ntz")
    queries, titles = corpus.where("id % 5 = 0").select(F.col("id").alias("query_id"), "vec", F.col("created_at").alias("cutoff")), corpus.where("id % 7 <> 0").select("id", "vec")
    searches = lambda: [rows(retrieve.dense_topk(queries, corpus, 4)), rows(retrieve.dense_topk_postfilter(queries, corpus, 4)), rows(retrieve.title_weighted_topk(queries, corpus, titles, 4))]
    want = searches()
    monkeypatch.setattr(retrieve, "NUMBERS", 240)
    got = searches()
    for a, b in zip(want, got):
        assert a and [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=2e-6)


def test_idf_stores_only_counts_of_words(spark, monkeypatch):
    """No table of documents and their words is written, and the words are not gone through again for the mean."""
    from millrace.plans import queries

    made = []
    for module in (retrieve, queries):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: (made.append(df.columns), f(df, name))[1])
    out = queries.bm25_idf(spark, "/root/testdata/sf0.001")
    assert made == [["token", "df"]] and out.count()
    assert "regexp" not in out.select("token")._jdf.queryExecution().optimizedPlan().toString()


#: Queries that search with vectors, and how many searches each makes.
SEARCHES = {"mcnemar_exact": 2, "eval_recall_mrr": 1, "rrf_three_lists": 3, "knn_label_vote": 1, "dense_topk_postfilter": 1, "rerank_task": 1, "search_duplicates": 1}


@pytest.mark.parametrize("name", SEARCHES)
def test_a_query_holds_cells_of_bounded_size(spark, monkeypatch, name):
    """Small bounds stand for a large input: no task takes more than a small cell's rows or scores at a time, and the rows are the same."""
    import __spark_entry__ as entry

    run = lambda: sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()), key=repr)
    want, cells = run(), []
    for bound, value in (("CORPUS_BLOCK", 50), ("LEAST_BLOCK", 50), ("SCORES", 128)):
        monkeypatch.setattr(retrieve, bound, value)

    def best(scores, seen, ids, n, f=retrieve.best):
        assert len(ids) <= 100 and scores.size <= max(128, len(ids)), (scores.shape, len(ids))
        return f(scores, seen, ids, n)

    monkeypatch.setattr(retrieve, "best", best)
    monkeypatch.setattr(retrieve, "cell_scores", lambda q, c, k, n, cell, f=retrieve.cell_scores: (cells.append(k), f(q, c, k, n, cell))[1])
    assert want and run() == want
    assert len(cells) == SEARCHES[name] and min(cells) >= 8

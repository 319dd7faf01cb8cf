import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import mining
from millrace.sources import tracker
from millrace.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def node(n, labels=(), comments=(), created="2024-03-01T00:00:00Z", updated="2024-03-02T00:00:00Z", title="t"):
    return {"number": n, "title": title, "body": "a\0b", "state": "OPEN", "stateReason": None, "url": "u", "createdAt": created, "updatedAt": updated, "closedAt": None, "author": None,
            "labels": {"nodes": [{"name": x} for x in labels]}, "comments": {"totalCount": len(comments), "nodes": [{"databaseId": i, "author": {"login": "x"}, "body": "c", "createdAt": created} for i in comments]}}


def landed(path, *nodes):
    path.write_text("".join(json.dumps(x) + "\n" for x in nodes))
    return str(path)


def test_nodes_to_tables(spark, tmp_path):
    nodes = tracker.read_nodes(spark, landed(tmp_path / "a.json", node(1, ["x", "x", "y"], [7, None, 9]), node(2, created="2023-12-31T23:59:59Z"), node(3, [f"l{i}" for i in range(40)], range(1, 31))))
    cut = tracker.fetched(nodes)
    issues = {r.number: r for r in tracker.issues_from(cut).collect()}
    assert set(issues) == {1, 3} and issues[1].body == "ab" and issues[1].comments_fetched == 3 and issues[3].comment_count == 30 and issues[3].comments_fetched == 20
    assert sorted(r.id for r in tracker.comments_from(cut).where("issue_number = 3").collect()) == list(range(11, 31))
    assert sorted(r.id for r in tracker.comments_from(cut).where("issue_number = 1").collect()) == [7, 9]
    assert tracker.labels_from(cut).where("issue_number = 3").count() == 30 and tracker.labels_from(cut).where("issue_number = 1").count() == 2


def test_window_counts(spark, tmp_path):
    nodes = tracker.read_nodes(spark, landed(tmp_path / "a.json", node(1), node(2, created="2023-05-01T00:00:00Z"), {"title": "none"}))
    assert tuple(tracker.window_counts(nodes).first()) == (1, 1, 1)


def test_upsert_and_labels(spark):
    schema = "number long, title string, created_at int, updated_at int"
    stored = spark.createDataFrame([(1, "a", 1, 5), (2, "b", 2, 5)], schema)
    fresh = spark.createDataFrame([(1, "A", 9, 6), (2, "old", 9, 4), (3, "c", 3, 1)], schema)
    once = tracker.upsert(stored, fresh, "number", "updated_at", kept=("created_at",))
    want = {(1, "A", 1, 6), (2, "b", 2, 5), (3, "c", 3, 1)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in tracker.upsert(once, fresh, "number", "updated_at", kept=("created_at",)).collect()} == want
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "issue_number long, label string")
    new = spark.createDataFrame([(1, "z"), (1, "z")], "issue_number long, label string")
    assert sorted(tuple(r) for r in tracker.replace_labels(labels, stored.select(F.col("number").alias("issue_number")).where("issue_number = 1"), new).collect()) == [(1, "z"), (2, "y")]


def test_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = ingest.VersionedTable(spark, f"{tmp_path}/issues", tracker.issues_from(spark.createDataFrame([], schemas.NODE)).schema)
    merge = lambda old, new: tracker.upsert(old, tracker.latest(tracker.issues_from(new), ["number"], [F.desc("updated_at")]), "number", "updated_at", kept=("created_at",))
    go = lambda: ingest.stream_upsert(spark.readStream.schema(schemas.NODE).json(f"{tmp_path}/in"), table, merge, f"{tmp_path}/checkpoint")
    landed(tmp_path / "in/1.json", node(1, title="a"), node(2, title="b"))
    go()
    landed(tmp_path / "in/2.json", node(1, title="A", created="2024-04-01T00:00:00Z", updated="2024-05-01T00:00:00Z"), node(2, title="late", updated="2024-03-01T12:00:00Z"))
    go()
    state = lambda: {(r.number, r.title, r.created_at) for r in table.read().collect()}
    want = {(1, "A", dt.datetime(2024, 3, 1)), (2, "b", dt.datetime(2024, 3, 1))}
    assert state() == want
    v = table.version()
    go()  # nothing new
    assert table.version() == v and state() == want


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(1, "m", [1.0]), (2, "n", [2.0])], "issue_number long, model_name string, vec array<float>")
    tracker.write_vectors(v, f"{tmp_path}/v")
    tracker.write_vectors(v.where("model_name = 'm'").withColumn("issue_number", F.lit(9).cast("long")), f"{tmp_path}/v")
    assert sorted((r.issue_number, r.model_name) for r in spark.read.parquet(f"{tmp_path}/v").collect()) == [(2, "n"), (9, "m")]
    assert tracker.read_vectors(spark, f"{tmp_path}/v", "n", 1).collect() == [(2, [2.0])]
    with pytest.raises(Exception, match="vector of length 1"):
        tracker.read_vectors(spark, f"{tmp_path}/v", "n", 384).collect()
    tracker.write_lines(v, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    issues = spark.createDataFrame([(1, "t", "body", "OPEN", None, "u", T0), (2, "s", None, "OPEN", None, "u", T0)], "number long, title string, body string, state string, state_reason string, url string, created_at timestamp_ntz")
    labels = spark.createDataFrame([(1, "b"), (1, "C")], "issue_number long, label string")
    tracker.export_bundle(issues, labels, v.select(F.col("issue_number").alias("id"), "vec").where("id = 1"), f"{tmp_path}/x", {"recall_10": 0.5})
    got = spark.read.parquet(f"{tmp_path}/x/issues").collect()
    assert [(r.number, r.labels) for r in got] == [(1, "C,b")] and spark.read.json(f"{tmp_path}/x/manifest").first().issues == 1


def test_hard_negatives(spark):
    n = 40
    vec = lambda i: [1.0 - i / 1000, 0.0]
    corpus = spark.createDataFrame([(i, vec(i), T0 + dt.timedelta(minutes=i)) for i in range(n)], "id long, vec array<double>, created_at timestamp_ntz")
    texts = spark.createDataFrame([(i, "short" if i == 4 else f"a text of enough characters {i if i != 3 else 2}") for i in range(n)], "id long, text string")
    truth = spark.createDataFrame([(30, 2), (35, 2), (10, 0), (5, 6)], "duplicate long, canonical long")
    got = {}
    for r in mining.hard_negatives(truth, truth, corpus, texts, low=1, high=12).orderBy("place").collect():
        got.setdefault(r.duplicate, []).append(r.negative)
    # raw ranks 2 to 12; 2 is the canonical, 3 has the canonical's text, 4 is short; 10 has too few earlier rows
    assert got == {30: [1, 5, 6], 35: [1, 5, 6]}


def test_rerank_task_and_hold_out(spark):
    hits = spark.createDataFrame([(1, 7, 2), (1, 9, 1)], "query_id long, candidate_id long, rank int")
    queries = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, text string")
    assert {r.q: r.c for r in mining.rerank_task(hits, queries).collect()} == {1: [9, 7], 2: []}
    truth = spark.createDataFrame([(i, i + 1) for i in range(50)], "duplicate long, canonical long")
    a, b = ({r.duplicate for r in mining.hold_out(truth, 10).where("held_out").collect()} for _ in range(2))
    assert a == b and len(a) == 10

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join((os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")))

import fake_client
from millrace import __main__ as cli
from millrace import schemas
from millrace.functions import encoders
from millrace.plans import adapters
from millrace.sources import paged, tracker


def numbers(*args, **kw):
    return [x["number"] for x, _ in paged.pages(fake_client.fetch, *args, sleep=lambda s: None, **kw)]


def test_pages_end_at_their_bounds():
    assert numbers("backfill", None, 5, None, None) == list(range(28, 0, -1))
    assert numbers("backfill", None, 5, None, "2024-01-20T00:00:00Z") == list(range(28, 19, -1))
    assert numbers("since", "2024-02-25T00:00:00Z", 5, None, None) == [28, 27, 26, 25]
    assert numbers("since", "2024-02-10T00:00:00Z", 5, None, "2024-01-26T00:00:00Z") == [28, 27, 26]
    assert numbers("backfill", None, 5, 7, None) == list(range(28, 21, -1))


def test_retry_gives_up_and_waits():
    waits = []

    def down(*a):
        raise paged.Transient("502")

    with pytest.raises(paged.Transient):
        paged.called(down, sleep=waits.append)
    assert waits == [1, 2, 4, 8]
    waits.clear()
    assert paged.called(lambda: {"nodes": [], "remaining": 3, "reset_in": 9}, sleep=waits.append)["remaining"] == 3 and waits == [9]


def test_data_source(spark):
    spark.sparkContext.addPyFile(fake_client.__file__)
    spark.dataSource.register(paged.PagedSource)
    read = lambda **o: sorted(r.n for r in spark.read.format("paged").options(client="fake_client:fetch", **o).load().select(F.get_json_object("node", "$.number").cast("int").alias("n")).collect())
    assert read(page_size="10") == list(range(1, 29))
    assert read(mode="keys", keys="3,5,99") == [3, 5]
    nodes = spark.read.format("paged").options(client="fake_client:fetch", limit="2").load().select(F.from_json("node", schemas.NODE).alias("x")).select("x.*")
    assert [r.title for r in tracker.issues_from(nodes.withColumn("comments", F.lit(None).cast(schemas.NODE["comments"].dataType))).orderBy("number").collect()] == ["t27", "t28"]


def test_stream_offsets():
    r = paged.PagedStreamReader({"client": "fake_client:fetch", "now": "2024-02-25T00:00:00Z"})
    import unittest.mock as m

    with m.patch.object(paged.time, "sleep", lambda s: None):
        rows, end = r.read(r.initialOffset())
        assert len(list(rows)) == 28 and end == {"since": "2024-02-25T00:00:00Z"}
        assert len(list(r.readBetweenOffsets(end, end))) == 4


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "  "), (3, "ccc")], "id long, text string")
    load = lambda: lambda batch: [[float(len(x))] for x in batch]
    assert {r.id: r.vec for r in encoders.encode(texts, load).collect()} == {1: [1.0], 3: [3.0]}
    assert [r.id for r in encoders.encode(texts, load, done=spark.createDataFrame([(1,)], "id long")).collect()] == [3]
    hits = spark.createDataFrame([(9, 1), (9, 3), (9, 4)], "query_id long, candidate_id long")
    queries = spark.createDataFrame([(9, "ab")], "query_id long, text string")
    scorer = lambda a, b: pd.Series([float(len(x) - len(y)) for x, y in zip(a, b)])
    assert {r.candidate_id: r.score for r in encoders.score_pairs(hits, queries, texts, scorer).collect()} == {1: 1.0, 3: -1.0, 4: 2.0}


def test_state_and_clamp(spark):
    state = spark.createDataFrame([], schemas.FETCH_STATE)
    assert tracker.get_state(state, "mark") is None
    state = tracker.set_state(tracker.set_state(state, "mark", "a"), "mark", "b")
    assert tracker.get_state(state, "mark") == "b" and state.count() == 1
    assert [tracker.clamped(n) for n in (-1, 5, 99)] == [1, 5, 20]


def test_tables_are_created_once(spark):
    for _ in range(2):
        schemas.create_tables(spark)
    assert spark.table("embeddings").columns[-1] == "model_name" and spark.table("issues").count() == 0
    for name in schemas.TABLES:
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pushdown_and_cli(spark, capsys, tmp_path):
    plan = adapters.issues(spark, "/root/testdata/sf0.001").where("number = 7").select("number", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert cli.main(["list"]) == 0 and "dense_topk" in capsys.readouterr().out
    assert cli.main(["state_counts", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3

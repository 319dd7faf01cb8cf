import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fake_client
from millrace import __main__ as cli
from millrace import schemas
from millrace.sources import tracker
from millrace.streaming import crawl


@pytest.fixture
def store(spark, tmp_path):
    spark.sparkContext.addPyFile(fake_client.__file__)
    return crawl.Store(spark, str(tmp_path))


def numbers(store):
    return sorted(r.number for r in store.tables["issues"].read().collect())


def test_a_crawl_goes_on_from_its_cursor(store):
    with pytest.raises(LookupError):
        crawl.crawl(store, "fake_client:fetch", since="auto")
    assert crawl.crawl(store, "fake_client:fetch", page_size=5, limit=7, step=1) == 10
    assert numbers(store) == list(range(19, 29)) and store.state("cursor_backfill") == "10" and store.state("mark") is None
    began = store.state("began_backfill")
    assert crawl.crawl(store, "fake_client:fetch", page_size=5, step=2) == 18
    assert numbers(store) == list(range(1, 29)) and store.state("cursor_backfill") is None and store.state("mark") == began
    assert crawl.crawl(store, "fake_client:fetch", since="2024-02-25T00:00:00Z") == 4
    assert crawl.top_up(store, "fake_client:fetch", [3, 99]) == 1 and len(numbers(store)) == 28
    stored = store.tables["issues"].read()
    assert stored.columns == schemas.ISSUES.names and stored.where("fetched_at is null").count() == 0


def test_the_bound_ends_a_backfill(store):
    assert crawl.crawl(store, "fake_client:fetch", page_size=5, start="2024-01-20 00:00:00", step=1) == 9
    assert numbers(store) == list(range(20, 29)) and store.state("mark")


def test_fetch_command(spark, tmp_path, capsys):
    spark.sparkContext.addPyFile(fake_client.__file__)
    root = ["fetch", "--root", str(tmp_path), "--client", "fake_client:fetch"]
    assert cli.main([*root, "--since", "auto"]) == 1 and "no mark" in capsys.readouterr().err
    assert cli.main([*root, "--numbers", "4, 5"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["issues"] == 2


def test_comments_have_no_version(spark):
    of = lambda *rows: spark.createDataFrame([(i, n, a, b, None) for i, n, a, b in rows], "id long, issue_number long, author string, body string, created_at timestamp_ntz")
    got = tracker.upsert_comments(of((1, 7, "a", "old"), (2, 7, "b", "stays")), of((1, 8, None, "new"), (3, 8, "c", "x"), (3, 8, "c", "y")))
    assert sorted((r.id, r.issue_number, r.author, r.body) for r in got.collect()) == [(1, 7, None, "new"), (2, 7, "b", "stays"), (3, 8, "c", "y")]


def test_vectors_by_issue_and_model(spark):
    of = lambda *rows: spark.createDataFrame([(n, m, v, None) for n, m, v in rows], schemas.EMBEDDINGS)
    got = tracker.upsert_vectors(of((1, "m", [1.0]), (1, "k", [2.0]), (2, "m", [3.0])), of((1, "m", [9.0])).drop("created_at"))
    assert sorted((r.issue_number, r.model_name, list(r.vec), r.created_at is None) for r in got.collect()) == [(1, "k", [2.0], True), (1, "m", [9.0], False), (2, "m", [3.0], True)]

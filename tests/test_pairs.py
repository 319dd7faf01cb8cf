import datetime as dt

import pytest

from millrace.operators import pairs

T0 = dt.datetime(2024, 1, 1)
ISSUES = "number long, state_reason string, created_at timestamp_ntz"
COMMENTS = "id long, issue_number long, body string, created_at timestamp_ntz"


def at(n):
    return T0 + dt.timedelta(hours=n)


def extracted(spark, *bodies, number=5):
    df = spark.createDataFrame([(i, number, b, at(i)) for i, b in enumerate(bodies)], COMMENTS)
    return [(r.canonical, r.pattern) for r in pairs.extract_canonical(df).collect()]


def test_priority_recency_and_self(spark):
    assert extracted(spark, "dup of #1", "Duplicate of #2") == [(2, "dup_of")]
    assert extracted(spark, "dup of #1", "tracked in #2") == [(1, "dup_of")]
    assert extracted(spark, "dup of #1", "duplicate of #5") == [(1, "dup_of")]
    # only the first match of a body is looked at
    assert extracted(spark, "tracked by #9", "dup of #5, dup of #7") == [(9, "tracked_in")]
    assert extracted(spark, "x\n /duplicate: #3") == [(3, "dup_colon")]
    assert extracted(spark, "covering the same as https://github.com/microsoft/vscode/issues/44") == [(44, "same_as")]
    assert extracted(spark, "fixed in the release [#8](x)") == [(8, "tracked_in")]
    assert extracted(spark, "fixed in 1. #8", "see #3", None, "dup of #99999999999999999999") == []


def test_ties_go_to_the_greater_id(spark):
    df = spark.createDataFrame([(1, 5, "dup of #1", at(0)), (2, 5, "dup of #2", at(0))], COMMENTS)
    assert pairs.extract_canonical(df).first().canonical == 2


def test_funnel_and_split(spark):
    issues = spark.createDataFrame([(i, "DUPLICATE" if i % 2 else None, at(i if i != 9 else 3)) for i in range(20)], ISSUES)
    labels = spark.createDataFrame([(2, "*Duplicate"), (4, "bug"), (999, "*duplicate")], "issue_number long, label string")
    marked = pairs.duplicate_ids(issues, labels)
    assert sorted(r.number for r in marked.collect()) == [1, 2, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    said = {1: "dup of #0", 2: "dup of #1", 3: "dup of #500", 5: "dup of #12", 7: "nothing", 9: "dup of #3", 11: "dup of #2", 13: "dup of #2", 15: "duplicate of #4"}
    comments = spark.createDataFrame([(i, i, b, at(50)) for i, b in said.items()], COMMENTS)
    rows = pairs.classified(marked, pairs.extract_canonical(comments), issues)
    funnel = {r.status: r.n for r in pairs.funnel(rows).collect()}
    assert funnel == {"usable": 5, "canonical_not_in_corpus": 1, "canonical_newer_than_query": 2, "no_canonical_in_text": 3}
    assert sum(funnel.values()) == marked.count()
    assert {r.pattern: r.n for r in pairs.pattern_hits(rows).collect()} == {"dup_of": 8}
    split = {r.duplicate: r.split for r in pairs.split(rows).collect()}
    assert split == {1: "train", 2: "train", 11: "train", 13: "train", 15: "test"}
    assert pairs.chained(pairs.split(rows), marked).first()[0] == 3


def test_frozen_pairs(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "dup_of", at(1), "train"), (2, 0, "dup_of", at(2), "test")], "duplicate long, canonical long, pattern string, created_at timestamp_ntz, split string")
    meta = spark.createDataFrame([(2,)], "duplicate_marked long")
    pairs.freeze(df, meta, f"{tmp_path}/p")
    assert pairs.load(spark, f"{tmp_path}/p").count() == 2
    assert [tuple(r) for r in pairs.load(spark, f"{tmp_path}/p", "test").collect()] == [(2, 0)]
    with pytest.raises(Exception, match="already exists"):
        pairs.freeze(df, meta, f"{tmp_path}/p")

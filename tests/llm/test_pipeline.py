"""The pipeline against a plain version of its stages."""

import brute
import numpy as np

import corpus_pipeline
from millrace.llm import common, quality, secrets


def plain(rows, kept):
    """(doc_id, text) that reach the packing stage."""
    rows = [(i, t) for i, t in rows if (i, t) in kept]
    groups = brute.components([(i, t) for i, t in rows])
    rows = sorted({(i, t) for i, t in rows if groups[i][1] == i})
    left = brute.substrings(rows)
    words = {i: brute.WORD.findall(t) for i, t in rows}
    seen = {}
    for i, w in words.items():
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {i: set() for i in words}
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                gone[i].update(range(k, k + 35))
    out = {}
    for (i, t), (_, n, k, digest) in zip(rows, left):
        assert k == len(gone[i])
        text = t if not k else " ".join(w for x, w in enumerate(words[i]) if x not in gone[i])
        if text:
            out[i] = secrets.redacted(text)
    return out


def test_stages_against_plain(spark, docs):
    docs = docs.where("doc_id is not null")
    kept = {(r.doc_id, r.text) for r in quality.keep(docs).collect()}
    got = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, got, "")
        if i < 4:
            got = common.stored(got, name)
            assert got.columns == docs.columns, name
            before = got
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows, kept)
    assert {r.doc_id: r.text for r in before.collect()} == want
    assert all(r.n_chars == len(r.text) for r in before.collect())
    pieces = got.collect()
    assert {p.doc_id for p in pieces} == set(want)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_take_nulls_and_empty_tables(spark, docs, none):
    for start in (docs, none):
        got = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, got, "")
            assert i == 4 or got.columns == start.columns
            got = common.stored(got, "s")
        assert got.count() >= 0


def test_run(spark, tmp_path, docs):
    docs.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and np.all(out.groupby("sequence_id").length.sum() <= 1024)

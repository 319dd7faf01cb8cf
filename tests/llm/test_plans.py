"""What the plans must and must not hold."""

from millrace.llm import bpe, fingerprints, packing, secrets, sharding, substrings
from millrace.llm.queries import END_OF_TEXT, ENCODING_RANKS, PACKING_RANKS, vocabulary


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sharding_is_native(docs):
    assert not any(x in plan(sharding.placed(docs)) for x in ("Python", "Pandas", "Arrow"))
    assert not any(x in plan(sharding.sized(docs)) for x in ("Python", "Pandas", "Arrow"))


def test_row_by_row_operators_do_not_exchange(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    rows = spark.read.parquet(f"{tmp_path}/d")
    for out in (secrets.scan(rows), packing.pack(rows, *vocabulary(PACKING_RANKS), END_OF_TEXT), bpe.round_trip(rows, *vocabulary(ENCODING_RANKS))):
        assert "Exchange" not in plan(out) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan(out)


def test_texts_are_exchanged_once(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    rows = spark.read.parquet(f"{tmp_path}/d")
    assert plan(fingerprints.with_successor(rows, 4)).count("Exchange") == 1
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        out = substrings.digest(rows)
        out.collect()
        final = plan(out).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    # anchors with the repeated ones, texts with flagged runs, texts with places
    assert "ReusedExchange" in final and final.count("SortMergeJoin") == 3
    assert "CartesianProduct" not in final and "NestedLoop" not in final

"""Test tables as tables of the issue-tracker model; each adapter has its SQL beside it.

documents are issues (title: first line, body: the rest, one a minute), conversations their
comments with references put in, embeddings their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import issue_text
from millrace.operators.pairs import TRACKER

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes(column: str):
    return F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(0, 0, {column}, 0)")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("number"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("body"),
        F.when(F.col("doc_id") % 3 == 0, "CLOSED").otherwise("OPEN").alias("state"),
        F.when(F.col("doc_id") % 9 == 0, "DUPLICATE").when(F.col("doc_id") % 3 == 0, "COMPLETED").alias("state_reason"),
        F.concat(F.lit(TRACKER), F.col("doc_id").cast("string")).alias("url"), minutes("doc_id").alias("created_at"), "text", "lang", "source",
    )


ISSUES = f"""issues AS (SELECT doc_id AS number, split_part(text, chr(10), 1) AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS body,
    CASE WHEN doc_id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS state,
    CASE WHEN doc_id % 9 = 0 THEN 'DUPLICATE' WHEN doc_id % 3 = 0 THEN 'COMPLETED' END AS state_reason,
    '{TRACKER}' || doc_id AS url, TIMESTAMP '{EPOCH}' + to_minutes(doc_id) AS created_at, text, lang, source FROM documents)"""


def issue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("*duplicate"))).otherwise(F.array().cast("array<string>"))
    return d.select(F.col("doc_id").alias("issue_number"), F.explode(F.concat(F.array("lang", "source"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("info-needed"))).otherwise(F.array().cast("array<string>")), mark)).alias("label"))


LABELS = """issue_labels AS (SELECT doc_id AS issue_number, lang AS label FROM documents UNION ALL SELECT doc_id, source FROM documents
    UNION ALL SELECT doc_id, 'info-needed' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, '*duplicate' FROM documents WHERE doc_id % 4 = 0)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    target = "cast((conv_id * 37 + turn * 11) % (conv_id + 20) as string)"
    said = F.expr(f"""concat(text, case (conv_id + turn) % 7 when 0 then concat(' Duplicate of #', {target}) when 1 then concat('\n/duplicate #', {target})
        when 2 then concat(' This is tracked in #', {target}) when 3 then concat(' covering the same as {TRACKER}', {target}) when 4 then concat(' see #', {target}) when 5 then concat(' dup of [#', cast(conv_id as string), '](x)') else '' end)""")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("issue_number"), F.col("role").alias("author"), said.alias("body"), minutes("conv_id + turn").alias("created_at"))


_TARGET = "((conv_id * 37 + turn * 11) % (conv_id + 20))"
COMMENTS = f"""comments AS (SELECT conv_id * 1000 + turn AS id, conv_id AS issue_number, role AS author, text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' Duplicate of #' || {_TARGET}
    WHEN 1 THEN chr(10) || '/duplicate #' || {_TARGET} WHEN 2 THEN ' This is tracked in #' || {_TARGET} WHEN 3 THEN ' covering the same as {TRACKER}' || {_TARGET}
    WHEN 4 THEN ' see #' || {_TARGET} WHEN 5 THEN ' dup of [#' || conv_id || '](x)' ELSE '' END AS body, TIMESTAMP '{EPOCH}' + to_minutes(conv_id + turn) AS created_at FROM conversations)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), minutes("vec_id").alias("created_at"), F.col("label").cast("string").alias("label"))


VECTORS = f"vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, TIMESTAMP '{EPOCH}' + to_minutes(vec_id) AS created_at, label::VARCHAR AS label FROM embeddings)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title vectors: the vector of the row before; one in seven has none."""
    return vectors(spark, sf_dir).select((F.col("id") + 1).alias("id"), "vec").where("id % 7 <> 0")


TITLES = "titles AS (SELECT id + 1 AS id, vec FROM vectors WHERE (id + 1) % 7 <> 0)"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: rows whose id is divisible by 100, against all rows."""
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec", F.col("created_at").alias("cutoff"))


QUERIES = "queries AS (SELECT id AS query_id, vec, created_at AS cutoff FROM vectors WHERE id % 100 = 0)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).select(F.col("number").alias("id"), issue_text(F.col("title"), F.col("body"), 1 << 30).alias("text"), "created_at")


_STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
COMPOSED = f"concat_ws(chr(10) || chr(10), nullif({_STRIPPED.format('title')}, ''), nullif({_STRIPPED.format('body')}, ''))"
TEXTS = f"texts AS (SELECT number AS id, {COMPOSED} AS text, created_at FROM issues)"


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth for evaluations: every query with the latest earlier row of the same label."""
    return latest_earlier(vectors(spark, sf_dir).select("id", "label")).where("id % 100 = 0").select(F.col("id").alias("duplicate"), "canonical")


def latest_earlier(rows: DataFrame, span: int = 65536) -> DataFrame:
    """(id, canonical) of rows (id, label): the greatest smaller id of the label, where there is one. No label is joined with itself:
    each span of a label's ids is gone through in order, and the greatest ids of its spans by themselves."""
    own = rows.where("label is not null").withColumn("span", F.floor(F.col("id") / span))
    of = Window.partitionBy("label").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy("label", "span").agg(F.max("id").alias("end")).select("label", "span", F.max("end").over(of).alias("end"))
    within = Window.partitionBy("label", "span").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    found = own.withColumn("canonical", F.max("id").over(within)).join(ends, ["label", "span"])
    return found.select("id", F.coalesce("canonical", "end").alias("canonical")).where("canonical is not null")


PAIRS = "pairs AS (SELECT a.id AS duplicate, max(b.id) AS canonical FROM vectors a JOIN vectors b ON a.label = b.label AND b.id < a.id WHERE a.id % 100 = 0 GROUP BY a.id)"


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies with their first occurrence."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), "text")
    first = d.groupBy("m").agg(F.min("doc_id").alias("canonical"))
    return d.join(first, "m").where("doc_id > canonical").select(F.col("doc_id").alias("duplicate"), "canonical")


TEXT_PAIRS = "text_pairs AS (SELECT doc_id AS duplicate, f AS canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id > f)"

"""Landed tracker pages: nested nodes to tables, upserts into Parquet, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import issue_text, naive_utc, snippet, without_nul
from millrace.schemas import NODE

CORPUS_START, LABELS, COMMENTS = "2024-01-01 00:00:00", 30, 20


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or gzip, of one node each."""
    return spark.read.schema(NODE).json(path)


def fetched(nodes: DataFrame) -> DataFrame:
    """What one call returns of a node: the first LABELS labels and the last COMMENTS comments."""
    labels = F.struct(F.slice("labels.nodes", 1, LABELS).alias("nodes"))
    n = F.size("comments.nodes")
    comments = F.struct(F.col("comments.totalCount").alias("totalCount"), F.slice(F.col("comments.nodes"), F.greatest(n - COMMENTS + 1, F.lit(1)), F.lit(COMMENTS)).alias("nodes"))
    return nodes.withColumns({"labels": labels, "comments": comments})


def issues_from(nodes: DataFrame, start: str | None = CORPUS_START) -> DataFrame:
    """Issue rows created since start. comments_fetched counts all comment nodes."""
    rows = nodes.where("number is not null").select(
        "number", without_nul(F.col("title")).alias("title"), without_nul(F.col("body")).alias("body"), "state", F.col("stateReason").alias("state_reason"), F.col("author.login").alias("author"), "url",
        naive_utc(F.col("createdAt")).alias("created_at"), naive_utc(F.col("updatedAt")).alias("updated_at"), naive_utc(F.col("closedAt")).alias("closed_at"),
        F.col("comments.totalCount").alias("comment_count"), F.greatest(F.size("comments.nodes"), F.lit(0)).alias("comments_fetched"),
    )
    return rows if start is None else rows.where(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))


def issue_rows(nodes: DataFrame, start: str | None = CORPUS_START) -> DataFrame:
    """issues_from with the time of the fetch, as schemas.ISSUES has it."""
    return issues_from(nodes, start).withColumn("fetched_at", F.current_timestamp())


def comments_from(nodes: DataFrame) -> DataFrame:
    """Comment rows; those without an id are dropped."""
    c = nodes.select(F.col("number").alias("issue_number"), F.explode("comments.nodes").alias("c")).where("c.databaseId is not null")
    return c.select(F.col("c.databaseId").alias("id"), "issue_number", F.col("c.author.login").alias("author"), without_nul(F.col("c.body")).alias("body"), naive_utc(F.col("c.createdAt")).alias("created_at"))


def labels_from(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("number").alias("issue_number"), F.explode("labels.nodes").alias("l")).select("issue_number", F.col("l.name").alias("label")).distinct()


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, version: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """stored with fresh rows by key. The greatest version wins, fresh on ties; columns in `kept`
    stay as they were first stored. Applying the same rows again changes nothing."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    last = latest(both, [key], [F.desc_nulls_last(version), F.desc("__new")]).drop("__new")
    if not kept:
        return last.select(*stored.columns)
    old = stored.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in kept])
    joined = last.join(old, last[key] == old["__key"], "left_outer")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in kept else F.col(c) for c in stored.columns])


def upsert_comments(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with fresh comments by id. They carry no version, so the fresh author and body win; issue and
    time stay as first stored. Of fresh rows with one id, the greatest by time, author and body counts."""
    new = latest(fresh, ["id"], [F.desc_nulls_last(c) for c in ("created_at", "author", "body", "issue_number")])
    old, found = stored.alias("old"), new.alias("new")
    joined = old.join(found, F.col("old.id") == F.col("new.id"), "full_outer")
    fresh_first = {c: F.when(F.col("new.id").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ("author", "body")}
    return joined.select(*[fresh_first.get(c, F.coalesce(f"old.{c}", f"new.{c}").alias(c)) for c in stored.columns])


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with fresh vectors by issue and model, each with the time at which it was written. One fresh
    row for each key is expected; of several the greatest vector counts."""
    key = ["issue_number", "model_name"]
    new = latest(fresh, key, [F.desc("vec")]).withColumn("created_at", F.current_timestamp())
    return stored.join(new, key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def replace_labels(stored: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Labels of touched issues (issue_number) are replaced by fresh ones, others stay."""
    return stored.join(touched.select("issue_number").distinct(), "issue_number", "left_anti").unionByName(fresh.select(*stored.columns).distinct())


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vectors (issue_number, model_name, vec): overwrites only the partitions of its models."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name").parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, gzip."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def serving(issues: DataFrame, labels: DataFrame) -> DataFrame:
    """Denormalised metadata with a snippet and comma-joined labels in binary order."""
    joined = labels.groupBy("issue_number").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    out = issues.join(joined, issues.number == joined.issue_number, "left_outer")
    return out.select("number", "title", snippet(F.col("title"), F.col("body")).alias("snippet"), "state", "state_reason", "url", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.coalesce("labels", F.lit("")).alias("labels"))


def export_bundle(issues: DataFrame, labels: DataFrame, vectors: DataFrame, path: str, metrics: dict | None = None) -> None:
    """Serving tables and a manifest whose figures are counted or given, never fixed."""
    served = issues.join(vectors.select(F.col("id").alias("number")), "number", "left_semi")
    serving(served, labels).sortWithinPartitions("created_at").write.mode("overwrite").parquet(f"{path}/issues")
    vectors.write.mode("overwrite").parquet(f"{path}/embeddings")
    manifest(served, metrics or {}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(issues: DataFrame, metrics: dict) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("issues"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last"), *[F.lit(v).alias(k) for k, v in metrics.items()])


def fetch_issue(issues: DataFrame, number: int, chars: int = 2000) -> DataFrame:
    """One issue with its body cut, or one row with error set."""
    spark = issues.sparkSession
    wanted = spark.range(1).select(F.lit(number).cast("long").alias("number"))
    found = issues.where(F.col("number") == number)
    return wanted.join(found, "number", "left_outer").select("number", "title", F.substring("body", 1, chars).alias("body"), F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.when(F.col("created_at").isNull(), F.format_string("issue %d not found", "number")).alias("error"))


def text_export(issues: DataFrame, vectors: DataFrame, max_chars: int = 2000, clean: bool = False) -> DataFrame:
    """(n, t) of issues that have no vector yet and whose text is not blank."""
    todo = issues.join(vectors.select(F.col("id").alias("number")), "number", "left_anti")
    return todo.select(F.col("number").alias("n"), issue_text(F.col("title"), F.col("body"), max_chars, clean).alias("t")).where(F.length("t") > 0)


def get_state(state: DataFrame, key: str) -> str | None:
    """A value of a key-value table (k, v, updated_at)."""
    row = state.where(F.col("k") == key).select("v").first()
    return row["v"] if row else None


def set_state(state: DataFrame, key: str, value: str | None) -> DataFrame:
    fresh = state.sparkSession.range(1).select(F.lit(key).alias("k"), F.lit(value).cast("string").alias("v"), F.current_timestamp().alias("updated_at"))
    return upsert(state, fresh, "k", "updated_at")


def clamped(n: int, low: int = 1, high: int = 20) -> int:
    """How many hits a live search may ask for."""
    return max(low, min(high, n))


def read_vectors(spark: SparkSession, path: str, model: str | None = None, dim: int | None = None) -> DataFrame:
    """(id, vec) of one model's partition. With dim, a vector of another length fails the read."""
    v = spark.read.parquet(path)
    v = v if model is None else v.where(F.col("model_name") == model)
    vec = F.col("vec") if dim is None else F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("vector of length "), F.size("vec").cast("string"))))
    return v.select(F.col("issue_number").alias("id"), vec.alias("vec"))


def window_counts(nodes: DataFrame, start: str = CORPUS_START) -> DataFrame:
    """Nodes inside the corpus window, before it, and without a number."""
    made = naive_utc(F.col("createdAt"))
    bound = F.lit(start).cast("timestamp_ntz")
    return nodes.agg(F.count_if(F.col("number").isNotNull() & (made >= bound)).alias("inside"), F.count_if(F.col("number").isNotNull() & (made < bound)).alias("before"), F.count_if(F.col("number").isNull()).alias("empty"))

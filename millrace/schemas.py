"""Declared schemas of the issue-tracker data model."""

from pyspark.sql import types as T

ISSUES = T.StructType([
    T.StructField("number", T.LongType(), False), T.StructField("title", T.StringType(), False), T.StructField("body", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("state_reason", T.StringType()), T.StructField("author", T.StringType()), T.StructField("url", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()), T.StructField("closed_at", T.TimestampNTZType()), T.StructField("comment_count", T.IntegerType()), T.StructField("comments_fetched", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
])
COMMENTS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("issue_number", T.LongType(), False), T.StructField("author", T.StringType()), T.StructField("body", T.StringType()), T.StructField("created_at", T.TimestampNTZType())])
ISSUE_LABELS = T.StructType([T.StructField("issue_number", T.LongType(), False), T.StructField("label", T.StringType(), False)])
FETCH_STATE = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("v", T.StringType()), T.StructField("updated_at", T.TimestampType())])
EMBEDDINGS = T.StructType([T.StructField("issue_number", T.LongType(), False), T.StructField("model_name", T.StringType(), False), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("created_at", T.TimestampType())])

_ACTOR = T.StructType([T.StructField("login", T.StringType())])
#: A landed API node, nested as the tracker returns it.
NODE = T.StructType([
    T.StructField("number", T.LongType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("state", T.StringType()), T.StructField("stateReason", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("createdAt", T.StringType()), T.StructField("updatedAt", T.StringType()), T.StructField("closedAt", T.StringType()), T.StructField("author", _ACTOR),
    T.StructField("labels", T.StructType([T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))])),
    T.StructField("comments", T.StructType([T.StructField("totalCount", T.IntegerType()), T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("databaseId", T.LongType()), T.StructField("author", _ACTOR), T.StructField("body", T.StringType()), T.StructField("createdAt", T.StringType())])))])),
])

TABLES = {"issues": ISSUES, "comments": COMMENTS, "issue_labels": ISSUE_LABELS, "fetch_state": FETCH_STATE, "embeddings": EMBEDDINGS}


def create_tables(spark, database: str | None = None) -> None:
    """Creates the tables that do not exist, as Parquet; embeddings by model. Running it again changes nothing."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema)
        by = " PARTITIONED BY (model_name)" if name == "embeddings" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {f'{database}.' if database else ''}{name} ({columns}) USING parquet{by}")

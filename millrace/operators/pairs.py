"""Labelled duplicate pairs from marks and comments: extraction, funnel, chronological split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: where full references point; a parameter of the functions below.
TRACKER = "https://github.com/microsoft/vscode/issues/"
#: Pattern names in order of priority, with what precedes the reference. A bare reference never counts.
PATTERNS = (
    ("dup_of", r"(?i)\b(?:duplicate|dup)\s+of\s+"),
    ("dup_colon", r"(?imd)^\s*/?(?:duplicate|dup)\b[:\s]+"),
    ("same_as", r"(?i)covering the same as\s+"),
    ("tracked_in", r"(?i)\b(?:tracked|fixed|covered)\s+(?:in|by|here)\b[^.\n]{0,40}?"),
)
TEST_FRACTION = 0.2


def reference(tracker: str = TRACKER) -> str:
    escaped = "".join(f"\\{c}" if c in ".?+*()[]{}|^$" else c for c in tracker)
    return rf"\[?(?:#|{escaped})(\d+)"


def duplicate_ids(issues: DataFrame, labels: DataFrame) -> DataFrame:
    """Numbers marked by close reason or by label, in any case."""
    by_reason = issues.where(F.upper("state_reason") == "DUPLICATE").select("number")
    marked = labels.where(F.lower("label") == "*duplicate").select(F.col("issue_number").alias("number"))
    return by_reason.union(issues.select("number").join(marked, "number", "left_semi")).distinct()


def extract_canonical(comments: DataFrame, tracker: str = TRACKER) -> DataFrame:
    """(number, canonical, pattern): the first pattern that matches, in the newest comment that
    it matches. Only the first match in a body is looked at; one to the issue itself is passed over."""
    found = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("pattern"), F.regexp_extract(F.col("body"), before + reference(tracker), 1).alias("ref")) for i, (name, before) in enumerate(PATTERNS)])
    hits = comments.where("body is not null").select("issue_number", "id", "created_at", F.explode(found).alias("x")).where("x.ref <> ''")
    hits = hits.select(F.col("issue_number").alias("number"), "id", "created_at", "x.i", "x.pattern", F.expr("try_cast(x.ref as bigint)").alias("canonical")).where("canonical is not null and canonical <> number")
    order = Window.partitionBy("number").orderBy("i", F.desc("created_at"), F.desc("id"))
    return hits.withColumn("r", F.row_number().over(order)).where("r = 1").select("number", "canonical", "pattern")


def classified(marked: DataFrame, extracted: DataFrame, issues: DataFrame) -> DataFrame:
    """marked with canonical, pattern, created_at and status, one of the funnel's four."""
    own = issues.select("number", "created_at")
    target = issues.select(F.col("number").alias("canonical"), F.col("created_at").alias("c_created"))
    return (
        marked.join(own, "number").join(extracted, "number", "left_outer").join(target, "canonical", "left_outer")
        .withColumn("status", F.when(F.col("canonical").isNull(), "no_canonical_in_text").when(F.col("c_created").isNull(), "canonical_not_in_corpus").when(F.col("c_created") >= F.col("created_at"), "canonical_newer_than_query").otherwise("usable"))
    )


def funnel(rows: DataFrame) -> DataFrame:
    """Counts by status; they add up to the marked issues."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pattern_hits(rows: DataFrame) -> DataFrame:
    """Counts by pattern, before the checks against the corpus."""
    return rows.where("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def split(rows: DataFrame, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Usable pairs, the earliest floor(n (1 - test_fraction)) for training. Pairs are labels, few
    beside the corpus; positions come from counts by day, so that no task sorts them all."""
    usable = rows.where("status = 'usable'").select(F.col("number").alias("duplicate"), "canonical", "pattern", "created_at")
    day = F.to_date("created_at")
    days = usable.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = days.agg(F.sum("n")).first()[0] or 0
    cut = int(total * (1 - test_fraction))
    place = F.row_number().over(Window.partitionBy("day").orderBy("created_at", "duplicate"))
    return usable.withColumn("day", day).join(before, "day").withColumn("split", F.when(F.col("before") + place <= cut, "train").otherwise("test")).drop("day", "before")


def chained(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """How many canonicals are marked as duplicates themselves."""
    return pairs.join(marked.select(F.col("number").alias("canonical")), "canonical", "left_semi").agg(F.count(F.lit(1)).alias("chained_canonicals"))


def pair_meta(rows: DataFrame, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """One row that describes a pair set: marked issues, the funnel, training and test pairs. rows: classified()."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("no_canonical_in_text", "canonical_not_in_corpus", "canonical_newer_than_query", "usable")}
    out = rows.agg(F.count(F.lit(1)).alias("duplicate_marked"), *n.values())
    train = F.floor(F.col("usable") * F.lit(1 - test_fraction)).cast("long")
    return out.withColumn("train", train).withColumn("test", F.col("usable") - F.col("train"))


def freeze(pairs: DataFrame, meta: DataFrame, path: str) -> None:
    """Writes a pair set once; an existing one is not touched, so that a benchmark can't move silently."""
    pairs.write.mode("errorifexists").json(f"{path}/pairs", compression="gzip")
    meta.coalesce(1).write.mode("errorifexists").json(f"{path}/meta")


def load(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(duplicate, canonical) of a frozen set; split None gives all."""
    rows = spark.read.schema("duplicate long, canonical long, pattern string, created_at timestamp_ntz, split string").json(f"{path}/pairs")
    return (rows if split is None else rows.where(F.col("split") == split)).select("duplicate", "canonical")

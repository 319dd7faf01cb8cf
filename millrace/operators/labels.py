"""Label suggestion by a similarity-weighted vote of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels of the triage process, which say nothing about content.
PROCESS_LABELS = (
    "info-needed", "triage-needed", "verified", "verification-needed", "verification-found", "verification-steps-needed", "insiders-released",
    "unreleased", "new release", "candidate", "confirmed", "spam", "author-verification-requested", "z-author-verified", "ai-translated",
)


def is_content(label: Column) -> Column:
    return ~label.startswith("*") & ~label.isin(*PROCESS_LABELS)


def knn_vote(hits: DataFrame, labels: DataFrame, n: int, digits: int | None = 3) -> DataFrame:
    """(query_id, label, confidence, rank): each neighbour adds its score, at least 0, to its content
    labels; a confidence is a share of all votes, those beyond the n best included. digits None: unrounded."""
    votes = hits.join(labels.where(is_content(F.col("label"))).select(F.col("issue_number").alias("candidate_id"), "label"), "candidate_id")
    sums = votes.groupBy("query_id", "label").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("score"))), 6).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("query_id"))
    share = F.col("votes") / F.when(total > 0, total).otherwise(1.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    out = sums.withColumn("confidence", share if digits is None else F.round(share, digits)).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= n).select("query_id", "label", "confidence", "rank")


def label_metrics(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Micro precision, recall, F1 and any_correct. predicted: query_id, label. gold: query_id, label;
    queries without a content label are not scored."""
    truth = gold.where(is_content(F.col("label"))).select("query_id", "label").distinct()
    got = predicted.select("query_id", "label").distinct().withColumn("p", F.lit(1))
    per = truth.withColumn("g", F.lit(1)).join(got, ["query_id", "label"], "full_outer").groupBy("query_id").agg(F.sum(F.col("p") * F.col("g")).alias("hits"), F.sum("p").alias("preds"), F.sum("g").alias("golds")).where("golds > 0").na.fill(0)
    s = per.agg(F.count(F.lit(1)).alias("issues_scored"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "preds", "golds")], F.count_if(F.col("hits") > 0).alias("exact"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = over("hits", "preds"), over("hits", "golds")
    return s.select("issues_scored", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), F.round(over("exact", "issues_scored"), 4).alias("any_correct"))

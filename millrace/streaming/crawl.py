"""A resumable crawl of a paged API into versioned tables under one folder.

A step reads a number of pages from the saved cursor on an executor, lands them as Parquet, merges them
into issues, comments and issue_labels, and only then saves the next cursor. A crash costs one step, and
a step that runs twice changes nothing. The high-water mark is the time at which the crawl began, kept
through resumptions, and is set when the feed has ended: what changed meanwhile comes with the next one."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.sources import paged, tracker
from millrace.streaming.ingest import VersionedTable

MARK, STEP = "mark", 200


class Store:
    """The tables issues, comments, issue_labels and fetch_state of a crawl."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {n: VersionedTable(spark, f"{self.root}/{n}", schemas.TABLES[n]) for n in ("issues", "comments", "issue_labels", "fetch_state")}

    def state(self, key: str) -> str | None:
        return tracker.get_state(self.tables["fetch_state"].read(), key)

    def save(self, **values: str | None) -> None:
        """All values in one version of the table."""
        state = self.tables["fetch_state"].read()
        for key, value in values.items():
            state = tracker.set_state(state, key, value)
        self.tables["fetch_state"].write(state.coalesce(1))

    def merge(self, nodes: DataFrame) -> None:
        """Issues first, as comments and labels refer to them. Of a node that came twice the newest counts."""
        nodes = tracker.latest(nodes.where("number is not null"), ["number"], [F.desc_nulls_last("updatedAt")])
        issues, comments, labels = (self.tables[n] for n in ("issues", "comments", "issue_labels"))
        issues.write(tracker.upsert(issues.read(), tracker.issue_rows(nodes, None), "number", "updated_at", kept=("created_at",)))
        comments.write(tracker.upsert_comments(comments.read(), tracker.comments_from(nodes)))
        labels.write(tracker.replace_labels(labels.read(), nodes.select(F.col("number").alias("issue_number")), tracker.labels_from(nodes)))

    def landed(self, options: dict) -> DataFrame:
        self.spark.dataSource.register(paged.PagedSource)
        path = f"{self.root}/landing"
        self.spark.read.format("paged").options(**options).load().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def counts(self) -> dict[str, int]:
        return {n: t.read().count() for n, t in self.tables.items()}


def parsed(landed: DataFrame) -> DataFrame:
    return landed.where("node is not null").select(F.from_json("node", schemas.NODE).alias("n")).select("n.*")


def crawl(store: Store, client: str, since: str | None = None, page_size: int = paged.PAGE, limit: int | None = None, start: str | None = tracker.CORPUS_START, step: int = STEP) -> int:
    """Takes in a backfill, or what was updated since a time (auto: the mark of the last crawl that ended,
    an error if none did). Returns the number of nodes. A crawl that a limit cuts short leaves the mark."""
    if since == "auto" and not (since := store.state(MARK)):
        raise LookupError("no crawl has ended yet, so there is no mark to go on from")
    mode = "since" if since else "backfill"
    at, begun = f"cursor_{mode}", f"began_{mode}"
    cursor = store.state(at)
    began = cursor and store.state(begun) or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    bound = start and start.replace(" ", "T") + ("" if start.endswith("Z") else "Z")
    fixed = {"client": client, "mode": mode, "page_size": page_size, "pages": step, "since": since, "start": bound}
    n = 0
    while limit is None or n < limit:
        asked = fixed | {"cursor": cursor, "limit": limit and limit - n}
        landed = store.landed({k: str(v) for k, v in asked.items() if v is not None})
        store.merge(parsed(landed))
        n += landed.where("node is not null").count()
        cursor = landed.where("node is null").orderBy(F.desc("page")).first()["cursor"]
        if cursor is None:
            store.save(**{at: None, begun: None, MARK: began})
            break
        store.save(**{at: cursor, begun: began})
    return n


def top_up(store: Store, client: str, numbers: list[int]) -> int:
    """Takes in some issues by number; cursor and mark stay as they are."""
    landed = store.landed({"client": client, "mode": "keys", "keys": ",".join(map(str, numbers))})
    store.merge(parsed(landed))
    return landed.count()

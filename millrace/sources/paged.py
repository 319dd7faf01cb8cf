"""A paged API as a Spark data source, batch and streaming.

``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged")`` with the options

    client   ``module:function``; the function takes (mode, cursor, since, page_size, keys) and
             returns {"nodes": [...], "cursor": str or None, "remaining": calls left or None}
    mode     backfill (default), since, or keys
    since    ISO time, for the mode since
    keys     comma-separated numbers, for the mode keys, asked for in chunks of CHUNK
    page_size, limit, start
    pages    for crawls that go on later: at most so many pages from the option cursor on. Rows are then
             (node, page, cursor): a page's nodes, and one row with a null node and the next page's
             cursor, null after the last

Nodes come as JSON strings in the column ``node``, for from_json with schemas.NODE. A call that
fails is repeated with growing pauses; when few calls remain, the reader waits. Chunks of keys
are read in parallel; pages, which follow a cursor, in one task."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE, CHUNK, TRIES, LEAST_REMAINING, PAUSE = 50, 40, 5, 150, 60.0


class Transient(Exception):
    """Raised by a client for what may pass: gateway errors, rate limits."""


def client_of(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def called(client, *args, tries: int = TRIES, sleep=time.sleep) -> dict:
    """One call, repeated after 1, 2, 4 ... seconds while it fails with Transient."""
    for i in range(tries):
        try:
            got = client(*args)
        except Transient:
            if i + 1 == tries:
                raise
            sleep(2.0**i)
            continue
        if got.get("remaining") is not None and got["remaining"] < LEAST_REMAINING:
            sleep(min(PAUSE, float(got.get("reset_in", PAUSE))))
        return got
    raise AssertionError("unreachable")


def feed(client, mode: str, since: str | None, page_size: int, start: str | None, cursor: str | None = None, sleep=time.sleep) -> Iterator[tuple[list[dict], str | None]]:
    """Pages as (nodes, cursor of the next page, None after the last). A sorted feed ends at the first
    node before its bound: created before start in a backfill, updated before since otherwise. Null
    nodes are passed over, and so are those of a refresh that were created before start."""
    while True:
        got = called(client, mode, cursor, since, page_size, None, sleep=sleep)
        kept, ended = [], False
        for node in got["nodes"]:
            if node is None:
                continue
            if mode == "since" and since and node["updatedAt"] < since or mode == "backfill" and start and node["createdAt"] < start:
                ended = True
                break
            if not (mode == "since" and start and node["createdAt"] < start):
                kept.append(node)
        cursor = None if ended else got["cursor"] or None
        yield kept, cursor
        if cursor is None:
            return


def pages(client, mode: str, since: str | None, page_size: int, limit: int | None, start: str | None, cursor: str | None = None, sleep=time.sleep) -> Iterator[tuple[dict, str | None]]:
    """(node, cursor of its page), at most limit of them."""
    n = 0
    for nodes, after in feed(client, mode, since, page_size, start, cursor, sleep):
        for node in nodes:
            yield node, cursor
            n += 1
            if limit and n >= limit:
                return
        cursor = after


class Keys(InputPartition):
    def __init__(self, keys: list[int] | None):
        self.keys = keys


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        if self.o.get("mode") != "keys":
            return [Keys(None)]
        keys = [int(k) for k in self.o.get("keys", "").split(",") if k.strip()]
        return [Keys(keys[i : i + CHUNK]) for i in range(0, len(keys), CHUNK)] or [Keys([])]

    def read(self, partition):
        client, o = client_of(self.o["client"]), self.o
        if partition.keys is not None:
            nodes = called(client, "keys", None, None, CHUNK, partition.keys)["nodes"] if partition.keys else []
            yield from ((json.dumps(x),) for x in nodes if x is not None)
            return
        asked = client, o.get("mode", "backfill"), o.get("since"), int(o.get("page_size", PAGE))
        limit = int(o["limit"]) if "limit" in o else None
        if "pages" in o:
            yield from self.marked(feed(*asked, o.get("start"), o.get("cursor")), int(o["pages"]), limit)
            return
        for node, _ in pages(*asked, limit, o.get("start")):
            yield (json.dumps(node),)

    @staticmethod
    def marked(found, most: int, limit: int | None):
        """Whole pages until there are `most` of them, or `limit` nodes."""
        n = 0
        for i, (nodes, after) in enumerate(found, 1):
            yield from ((json.dumps(x), i, None) for x in nodes)
            yield None, i, after
            n += len(nodes)
            if i >= most or limit and n >= limit:
                return


class PagedStreamReader(SimpleDataSourceStreamReader):
    """The offset is the high-water mark: the time at which the crawl before began."""

    def __init__(self, options):
        self.o = dict(options)

    def initialOffset(self):
        return {"since": self.o.get("since", "")}

    def read(self, start):
        began = self.o.get("now") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        mode = "since" if start["since"] else "backfill"
        found = pages(client_of(self.o["client"]), mode, start["since"] or None, int(self.o.get("page_size", PAGE)), None, self.o.get("start"))
        return iter([(json.dumps(x),) for x, _ in found]), {"since": max(began, start["since"])}

    def readBetweenOffsets(self, start, end):
        return self.read(start)[0]  # rows are upserted by key, so a few newer ones do no harm


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "node string, page int, cursor string" if "pages" in self.options else "node string"

    def reader(self, schema):
        return PagedReader(self.options)

    def simpleStreamReader(self, schema):
        return PagedStreamReader(self.options)

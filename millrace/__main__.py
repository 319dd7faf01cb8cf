"""python -m millrace COMMAND --data DIR [--out DIR]
python -m millrace fetch --root DIR --client MODULE:FUNCTION [--since TIME|auto | --numbers N,N] [--limit N]

fetch crawls a paged API into the tables under --root, or goes on with a crawl that was cut short, and
prints the tables' row counts. Other COMMANDs: tables, list, or the name of a query (dense_topk, pair_split, eval_recall_mrr, ...). A query
prints its first rows, or writes its result as Parquet to --out. --explain prints its plan."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from millrace import schemas
from millrace.plans import catalog
from millrace.sources import paged
from millrace.streaming import crawl


def fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    store = crawl.Store(spark, a.root)
    try:
        if a.numbers:
            crawl.top_up(store, a.client, [int(x) for x in a.numbers.replace(" ", "").split(",") if x])
        else:
            crawl.crawl(store, a.client, a.since, a.page_size, a.limit)
    except LookupError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(store.counts()))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command")
    p.add_argument("--data", help="folder with one Parquet file or folder for each table")
    p.add_argument("--out", help="folder for the result")
    p.add_argument("--rows", type=int, default=20, help="rows to print")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--root", help="folder of the crawled tables")
    p.add_argument("--client", help="module:function that calls the API, as sources.paged says")
    p.add_argument("--since", help="ISO time, or auto: the mark of the last crawl that ended")
    p.add_argument("--numbers", help="comma-separated issue numbers to take in")
    p.add_argument("--page-size", type=int, default=paged.PAGE)
    p.add_argument("--limit", type=int, help="stop after the page that reaches so many issues")
    a = p.parse_args(argv)
    queries = catalog.queries()
    if a.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.command == "fetch" and not (a.root and a.client):
        p.error("fetch needs --root and --client")
    if a.command not in ("tables", "fetch") and (a.command not in queries or not a.data):
        p.error("a query needs --data; `list` names the queries")
    spark = SparkSession.builder.appName(f"millrace-{a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "fetch":
        return fetch(spark, a)
    if a.command == "tables":
        schemas.create_tables(spark)
        return 0
    df = queries[a.command](spark, a.data)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

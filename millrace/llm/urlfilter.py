"""URL filters on a sorted digest array.

A list is a table of entries: rules (kind ``allow`` or ``block``, entry a host and a path prefix such as
``net/es/``) and blocked host labels (kind ``label``). Spark hashes each entry with 64-bit XXH64 and sorts the list by
digest; the driver joins the sorted parts, one at a time, to one file of digests, kinds, offsets and strings, which
Spark hands to every executor and a worker maps into memory. For each URL the host's suffixes of
the lengths that listed hosts have are joined with the path's beginnings of the lengths that go with them, all keys of a
batch are probed by vectorised binary search, and hits are confirmed against the stored strings, so that a
collision never decides.

The longest rule that fits gives the verdict; of equally long ones the longer host, then
``block``. If no rule fits, a URL is blocked if a label of its host is on the list, else allowed.

The file lies in the shared folder under a name that its entries give, so equal lists share one and a
second use of a list adds nothing; it is not removed with other tables, as executors that join late fetch it too.

Defined results: host and path of a null URL, or one without ``://``, are empty: no rule fits
and it is allowed. A URL of any length takes time in proportion to it. Rows are judged one by one, so repeated rows
agree; other columns are not looked at. An empty list allows everything. The file grows with the list, not with the pages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: The query's list where the setting LIST names none.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The setting that names the query's list file.
LIST = "spark.millrace.urlfilter.list"
KINDS = ("allow", "block", "label")
ALLOW, BLOCK, LABEL = 0, 1, 2
#: Entries of a part of the sorted list, which the driver holds one of at a time.
PART = 1 << 18
END = re.compile(rb"[/?#]")
PATH_END = re.compile(rb"[?#]")


def parts(url: bytes) -> tuple[bytes, bytes]:
    """Host, A-Z lower-cased, and path."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    m = END.search(rest)
    host, after = (rest[: m.start()], rest[m.start() :]) if m else (rest, b"")
    m = PATH_END.search(after)
    return host.lower(), after[: m.start()] if m else after


class Digests:
    """The mapped file: sizes, digests, offsets, lengths that occur (of a rule's host and path; of a label, with 0), kinds, strings."""

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", shape=(2,))
        n, m = int(head[0]), int(head[1])
        at = 16
        self.digests = np.memmap(path, np.int64, "r", at, (n,)) if n else np.zeros(0, np.int64)
        at += 8 * n
        self.offsets = np.memmap(path, np.int64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        lengths = np.memmap(path, np.int64, "r", at, (m, 2)).tolist() if m else []
        at += 16 * m
        self.kinds = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.zeros(0, np.uint8)
        self.strings = np.memmap(path, np.uint8, "r", at + n, (max(1, int(self.offsets[n])),))
        self.labels = {a for a, b in lengths if not b}
        self.hosts: dict[int, list[int]] = {}
        for a, b in sorted(x for x in lengths if x[1]):
            self.hosts.setdefault(a, []).append(b)

    def string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def keys(self, host: bytes, path: bytes) -> list[bytes]:
        """What may be on the list of this URL, by the lengths of what is."""
        n, out = len(host), []
        if not n:
            return out
        if host.count(b".") < len(self.hosts):
            ends, at = [], 0
            while at >= 0:
                ends.append(n - at)
                at = host.find(b".", at) + 1 or -1
        else:
            ends = self.hosts
        for size in ends:
            if size in self.hosts and (size == n or 0 < size < n and host[n - size - 1] == 46):
                suffix = host[n - size :]
                out += [suffix + path[:p] for p in self.hosts[size] if p <= len(path)]
        if self.labels:
            out += [b" " + x for x in host.split(b".") if len(x) in self.labels]
        return out

    def find(self, keys: list[bytes]) -> list[tuple[int, int]]:
        """(place in keys, entry) of each key that is on the list."""
        if not keys or not len(self.digests):
            return []
        probes = digests_of(keys)
        low = np.searchsorted(self.digests, probes)
        hits = np.flatnonzero(self.digests[np.minimum(low, len(self.digests) - 1)] == probes)
        out = []
        for k in hits.tolist():
            i = int(low[k])
            while i < len(self.digests) and self.digests[i] == probes[k]:
                if self.string(i) == keys[k]:
                    out.append((k, i))
                i += 1
        return out


def digests_of(keys: list[bytes]) -> np.ndarray:
    return common.signed(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64))


def rules_of(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "kind string, entry string")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file: lines of ``allow``, ``block`` or ``label``, white space and the rule or
    label. Empty lines and those that start with # are passed over, others are an error."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(words.alias("w"), "value")
    good = (F.size("w") == 2) & ((F.col("w")[0] == "label") | F.col("w")[0].isin("allow", "block") & F.contains(F.col("w")[1], F.lit("/")))
    return lines.select(F.when(good, F.col("w")[0]).otherwise(F.raise_error(F.concat(F.lit(f"{path}: not a rule or label: "), "value"))).alias("kind"), F.get("w", F.lit(1)).alias("entry"))


def keyed(entries: DataFrame) -> DataFrame:
    """(kind, key, host, path): each entry once, the string it is found by, and the lengths of its parts."""
    entry = F.col("entry")
    rows = entries.where(F.col("kind").isin(*KINDS) & entry.isNotNull()).select(
        (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int").alias("kind"), F.when(F.col("kind") == "label", F.concat(F.lit(" "), F.lower(entry))).otherwise(entry).cast("binary").alias("key"),
        F.when(F.col("kind") == "label", F.octet_length(entry)).otherwise(F.octet_length(F.split_part(entry, F.lit("/"), F.lit(1)))).alias("host"),
    )
    return rows.distinct().select("kind", "key", "host", F.when(F.col("kind") == LABEL, 0).otherwise(F.octet_length("key") - F.col("host")).alias("path"))


def coded(entries: DataFrame) -> DataFrame:
    """keyed() with the digest of each key."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests_of(batch.column(1).to_pylist()), pa.int64())], names=["kind", "key", "host", "path", "digest"])

    return keyed(entries).mapInArrow(run, "kind int, key binary, host int, path int, digest long")


def parted(batches):
    """Sorted entries packed into parts, numbered in their order."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            key, kind, digest = (batch.slice(at, PART).column(i) for i in range(3))
            keys = key.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(keys)], pa.int64())]
                + [pa.array([x], pa.binary()) for x in (digest.to_numpy().tobytes(), np.array(list(map(len, keys)), np.int64).tobytes(), kind.to_numpy().astype(np.uint8).tobytes(), b"".join(keys))],
                names=["part", "n", "digests", "sizes", "kinds", "strings"],
            )
            number += 1


def written(spark: SparkSession, entries: DataFrame) -> str:
    """Path of the list's file in the shared folder, which is made if there is none yet."""
    name = keyed(entries).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("kind", "key")), F.sum(F.xxhash64("key", "kind").cast("decimal(38,0)"))).first()
    with common.scratch(spark):
        path = f"{common.shared_dir(spark)}/millrace-lists/{xxhash.xxh128_hexdigest(repr(tuple(name)))}.digests"
        fs, at = common.hadoop_fs(spark, path)
        if fs.exists(at):
            return path
        rows = common.stored(coded(entries), "list")
        parts = common.stored(rows.orderBy("digest", "key", "kind").select("key", "kind", "digest").mapInArrow(parted, "part long, n long, digests binary, sizes binary, kinds binary, strings binary"), "sorted").orderBy("part")
        lengths = rows.select("host", "path").distinct().collect()  # as many as there are lengths of hosts and paths
        partial = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{xxhash.xxh64_hexdigest(common.new_path(spark, 'x'))}")
        out = fs.create(partial, True)
        out.write(np.array([name[0], len(lengths)], np.int64).tobytes())
        for r in parts.select("part", "digests").toLocalIterator():
            out.write(bytes(r["digests"]))
        end = np.zeros(1, np.int64)
        out.write(end.tobytes())
        for r in parts.select("part", "sizes").toLocalIterator():
            ends = end[-1] + np.cumsum(np.frombuffer(r["sizes"], np.int64))
            out.write(ends.tobytes())
            end = ends
        out.write(np.array([tuple(x) for x in lengths], np.int64).tobytes())
        for column in ("kinds", "strings"):
            for r in parts.select("part", column).toLocalIterator():
                out.write(bytes(r[column]))
        out.write(b"\0")
        out.close()
        if not fs.rename(partial, at) and not fs.exists(at):
            raise OSError(f"could not write {path}")
        fs.delete(partial, False)
    return path


def handed_out(spark: SparkSession, entries: DataFrame) -> str:
    """The name by which executors find their copy of the list's file."""
    path, sc = written(spark, entries), spark.sparkContext
    if path not in (known := sc.__dict__.setdefault("_millrace_lists", set())):
        sc.addFile(path)
        known.add(path)
    return path.rpartition("/")[2]


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(urls: list[bytes], digests: Digests) -> list[tuple[str, str, str | None, str]]:
    keys, owner, split = [], [], []
    for row, url in enumerate(urls):
        host, path = parts(url)
        split.append((host, path))
        own = digests.keys(host, path)
        keys += own
        owner += [row] * len(own)
    best: dict[int, tuple] = {}
    blocked = set()
    for k, i in digests.find(keys):
        kind, key = int(digests.kinds[i]), keys[k]
        if kind == LABEL:
            blocked.add(owner[k])
        elif key[:1] != b" ":
            rule = key.decode("utf-8", "replace")
            rank = (len(rule), rule.index("/"), kind)  # in code points
            if owner[k] not in best or rank > best[owner[k]][0]:
                best[owner[k]] = (rank, rule, kind)
    out = []
    for row, (host, path) in enumerate(split):
        _, rule, kind = best.get(row, (None, None, BLOCK if row in blocked else ALLOW))
        out.append((host.decode("utf-8", "replace"), path.decode("utf-8", "replace"), rule, "block" if kind == BLOCK else "allow"))
    return out


def judge(pages: DataFrame, entries: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages, by the list `entries` (kind, entry), or RULES. No exchange of the pages."""
    spark = pages.sparkSession
    name = handed_out(spark, rules_of(spark) if entries is None else entries)

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
        digests = Digests(SparkFiles.get(name))
        for batch in common.slices(batches, 8192):
            rows = judge_urls(common.bytes_of(batch.column(1)), digests)
            yield common.batch_of(schema, page_id=batch.column(0), **{c: [r[i] for r in rows] for i, c in enumerate(schema.names[1:])})

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url").mapInArrow(run, SCHEMA)


def sql(rules=RULES) -> str:
    """The same verdicts in DuckDB's SQL."""
    values = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in rules)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH rules(verdict, rule, r_host, r_path) AS (VALUES {values}),
    rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS r FROM pages),
    split AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
              regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fits AS (SELECT i, arg_max(rule, (length(rule), length(r_host), verdict)) AS rule, arg_max(verdict, (length(rule), length(r_host), verdict)) AS verdict
             FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY i)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM split LEFT JOIN fits USING (i)"""

"""Document fingerprints by winnowing.

Rolling hashes of all GRAM-character grams; in every window of WINDOW consecutive grams the
least hash is chosen, the rightmost on ties, and kept with its position. Any passage of at
least WINDOW + GRAM - 1 characters that two texts share puts a common hash into both
fingerprints. A fingerprint is written as ``hash:position`` pairs, hash in 8 hex digits,
position in code points, joined by commas in the order of positions. Likeness is the
Jaccard index of the sets of hashes.

Texts of under WINDOW + GRAM - 1 characters form one short window; those under GRAM
characters have one hash, of the whole text. Null and empty texts have the empty fingerprint,
and two empty fingerprints are alike (1.0).

A fingerprint says little about passages shorter than its guarantee, and of a text of one window
it keeps one hash, so its likeness is 0 or 1 there. near_edited_all and near_next_all therefore
give the Jaccard index of the sets of all FINE-character grams, nothing left out, for texts of
any length; texts of under FINE characters are one gram.

To edit each document with its successor, documents are dealt into ranges of doc_id and, where one id (or none)
fills several, of a hash of the text; the first document of each range also goes to the range before. So the texts
are exchanged once and no task sorts more than a range. Rows with equal ids are ordered by XXH64 of the text, then by text;
null ids come first. Rows that are equal in both stay in one range and are read as a stream. A single document is its own successor.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.hashing import MIX_1, powers

GRAM, WINDOW = 16, 64
#: Characters of a gram where all grams are compared.
FINE = 8
BASE = 0x9E3779B97F4A7C15
EMPTY = np.zeros(0, np.uint64)


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """32-bit rolling hashes of all grams, one for a shorter text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return EMPTY
    size = min(gram, len(points))
    up, down = powers(BASE, len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: len(points) - size + 1]
    return (h * np.uint64(MIX_1)) >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions."""
    h = gram_hashes(text, gram)
    n = len(h)
    if not n:
        return EMPTY, EMPTY
    # The position, turned around, stands below the hash: of equal hashes the rightmost is least.
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    span, size = min(window, n), 1
    while 2 * size <= span:  # least of `size` neighbours, doubled until it spans the window
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> np.uint64(32), np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))


def all_grams(text: str) -> np.ndarray:
    """The sorted set of the hashes of all FINE-character grams."""
    return np.unique(gram_hashes(text, FINE).astype(np.uint32))


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    return ",".join([f"{h:08x}:{p}" for h, p in zip(hashes.tolist(), positions.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_edited_all double, near_next_all double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("near_edited_all", pa.float64()), ("near_next_all", pa.float64())])


def compare(batches):
    """Takes (part, guest, doc_id, h, text) in this order."""
    last = None  # (part, doc_id, text, hashes, positions, sorted set, sorted set of all grams)
    done = None  # the part whose guest was met
    for batch in common.slices(batches):
        out = {c: [] for c in ARROW.names}
        for part, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if guest and part == done:
                continue
            text = text or ""
            h, p = winnow(text)
            s = np.unique(h)
            every = all_grams(text)
            if last is not None and last[0] == part:
                _, was, own, oh, op, os, oe = last
                new = edited(own, text)
                eh, ep = winnow(new)
                row = (was, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(oh, op), written(eh, ep), likeness(os, np.unique(eh)), likeness(os, s), likeness(oe, all_grams(new)), likeness(oe, every))
                for c, v in zip(ARROW.names, row):
                    out[c].append(v)
            last = (part, doc_id, text, h, p, s, every)
            if guest:
                done, last = part, None
        if out["doc_id"]:
            yield common.batch_of(ARROW, **out)


LOWEST = -(1 << 63)


def ranges(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """At most parts - 1 places (id, h) that split the rows into even ranges; null ids are LOWEST. An id that fills several is cut evenly by h."""
    if parts < 2:
        return []
    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    found = rows.selectExpr(f"percentile_approx(coalesce(doc_id, {LOWEST}L), array({shares}), {20 * parts}) as x").first()["x"] or []
    return sorted((i, (k + 1) * (1 << 64) // m + LOWEST - 1) for i, m in Counter(found).items() for k in range(m))


class Ranges:
    """Which range a row is in: how many of the places lie before it."""

    def __init__(self, places: list[tuple[int, int]]):
        self.n = len(places) + 1
        self.ids, self.h = (np.array([p[k] for p in places], np.int64) for k in (0, 1))

    def of(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        part, end = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for a in np.unique(part[end > part]).tolist():  # ids that are places themselves
            own = np.flatnonzero((part == a) & (end > part))
            part[own] = a + np.searchsorted(self.h[a : end[own[0]]], h[own], "left")
        return part


def with_successor(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("text"))
    parts = parts or max(2 * common.partitions(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = Ranges(ranges(rows, parts))

    def part_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, h = batch.column(0).fill_null(LOWEST).to_numpy(), batch.column(1).to_numpy()
        return split.of(ids, h), ids, h

    def dealt(batches):
        schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("h", pa.int64())])
        for batch in batches:
            part, ids, h = part_of(batch)
            yield common.batch_of(schema, part=part.astype(np.int32), id=ids, h=h)

    # The first place of each range: as many rows as there are ranges.
    heads = {r["part"]: tuple(r["x"]) for r in rows.select("doc_id", "h").mapInArrow(dealt, "part int, id long, h long").groupBy("part").agg(F.min(F.struct("id", "h")).alias("x")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    before_of = np.array([before.get(p, -1) for p in range(split.n)], np.int64)
    head_of = np.array([heads.get(p, (0, 0)) for p in range(split.n)], np.int64).reshape(-1, 2)

    def placed(batches):
        schema = pa.schema([("part", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("text", pa.string())])
        sent: set[int] = set()  # of equal heads one guest is enough, as only its text is read
        for batch in common.slices(batches, 2048):
            part, ids, h = part_of(batch)
            yield common.batch_of(schema, part=part.astype(np.int32), guest=np.zeros(len(ids), bool), doc_id=batch.column(0), h=batch.column(1), text=batch.column(2))
            first = [i for i in np.flatnonzero((head_of[part, 0] == ids) & (head_of[part, 1] == h)).tolist() if not (part[i] in sent or sent.add(part[i]))]
            if first:
                yield common.batch_of(schema, part=before_of[part[first]].astype(np.int32), guest=np.ones(len(first), bool), **{c: batch.column(k).take(pa.array(first)) for k, c in enumerate(("doc_id", "h", "text"))})

    out = rows.mapInArrow(placed, "part int, guest boolean, doc_id long, h long, text string")
    return out.repartitionById(split.n, "part").sortWithinPartitions("part", "guest", "doc_id", "h", "text").mapInArrow(compare, SCHEMA)

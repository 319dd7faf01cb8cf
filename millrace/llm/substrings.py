"""Substring dedup with a count-min prefilter.

A window is WINDOW consecutive words. Rows are taken in chunks of about CHUNK bytes of text; a chunk
is what asks and gets answers.

1. Sketch. Each window is hashed, by a polynomial of its bytes, into one counter of each of DEPTH rows. A chunk's own sketch, its counters that are not 0 with values that stop at 2,
   is sent in parts: the rows are cut into blocks of WIDTH counters. A block adds up the parts of all
   chunks, and tells each chunk which of the counters it sent stand at 2 or more. The estimate of a
   window is the least of its counters, never under its count, so no repeated window is lost. There are
   COUNTERS counters a window in all, so the sketch grows with the data, its blocks don't.
2. Exact count. Windows with an estimate of 2 or more are told apart by 128 bits of BLAKE2b over
   their bytes, which no one knows how to make collide. A chunk sends each of its distinct ones once, with a
   mark if it has it twice, to the block of the digest; that answers with one bit for each.

Places never leave their chunk, and only digests, counters and bits travel beside one exchange of the
texts, which both joins read. A passage of a third of all documents, or a row repeated any number of times, is one
entry for each chunk that holds it.

Words covered by a repeated window are removed. Defined results: null and empty texts have no words
and lose none; texts under WINDOW words lose none; repeated rows, even with equal or null ids, repeat each other's
windows; windows may overlap and may repeat inside one document; a text of any length is read whole, word by
word in pieces; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.hashing import mixed, powers

WINDOW = 35
#: Rows of the sketch, counters for each window in all rows together, and counters of a block.
DEPTH, COUNTERS, WIDTH = 2, 6, 1 << 25
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of text of a chunk; a longer text is a chunk by itself. Windows of a text that are hashed at a time.
CHUNK, PIECE = 2 << 20, 1 << 17
SEPARATOR = re.compile(rb"[ \t-\r]")
SPACED = bytes(32 if x in b"\t\n\v\f\r" else x for x in range(256))


def pieces(data: bytes, size: int = 0) -> Iterator[list[bytes]]:
    """The words of data, in lists of those of about 8 * PIECE bytes, or size."""
    size, at = size or 8 * PIECE, 0
    while len(data) - at > size:
        m = SEPARATOR.search(data, at + size)
        if not m:
            break
        yield data[at : m.start()].split()
        at = m.end()
    yield data[at:].split() if at else data.split()


class Words:
    """The words of one text, joined by single spaces, and where each begins and ends."""

    def __init__(self, data: bytes):
        joined = data.translate(SPACED)
        if joined[:1] == b" " or joined[-1:] == b" " or b"  " in joined:
            joined = b" ".join(x for x in (b" ".join(p) for p in pieces(data)) if x)
        self.joined = joined
        self.bytes = np.frombuffer(joined, np.uint8)
        space = np.flatnonzero(self.bytes == 32)
        self.n = len(space) + 1 if joined else 0
        self.starts, self.ends = np.concatenate([[0], space + 1])[: self.n], np.concatenate([space, [len(joined)]])[: self.n]

    def windows(self) -> np.ndarray:
        """A hash of each window: a polynomial of its bytes modulo 2**64. Equal windows have equal hashes, and
        that is all the sketch needs; others that meet only raise an estimate."""
        out = []
        for a in range(0, self.n - WINDOW + 1, PIECE):
            b = min(a + PIECE, self.n - WINDOW + 1)
            first, last = self.starts[a:b] - self.starts[a], self.ends[a + WINDOW - 1 : b + WINDOW - 1] - self.starts[a]
            data = self.bytes[self.starts[a] : self.starts[a] + last[-1]]
            up, down = powers(SEEDS[0], len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * up[:-1], out=sums[1:])
            out.append((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def digests(self, at: np.ndarray) -> list[bytes]:
        """128 bits of BLAKE2b of each of these windows."""
        joined, make = self.joined, hashlib.blake2b
        return [make(joined[a:b], digest_size=16).digest() for a, b in zip(self.starts[at].tolist(), self.ends[at + WINDOW - 1].tolist())]

    def without(self, gone: np.ndarray) -> bytes:
        """The words not gone, joined by one space."""
        if not gone.any():
            return self.joined
        turn = np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8))
        first, last = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1) - 1
        return b" ".join([self.joined[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist())])


def cells(h: np.ndarray, space: int) -> np.ndarray:
    """The counter of each window in each row: DEPTH x n places in one space."""
    row = np.uint64(space // DEPTH)
    return np.stack([mixed(h ^ np.uint64(s)) % row + np.uint64(i) * row for i, s in enumerate(SEEDS)])


def parts(places: np.ndarray, width: int) -> Iterator[tuple[int, slice]]:
    """(block, where its part is) of sorted places."""
    block = places // np.uint64(width)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.zeros(1, np.int64)
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        yield int(block[a]), slice(a, b)


def packed(places: np.ndarray) -> bytes:
    """Sorted places of a block as steps, in two bytes each if they fit."""
    step = np.diff(places, prepend=np.uint64(0))
    return b"\2" + step.astype("<u2").tobytes() if step.max() < 1 << 16 else b"\4" + step.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1), dtype=np.int64)


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


# ---- chunks

def numbered(batches, size: int) -> Iterator[tuple[pa.RecordBatch, list[int], int]]:
    """(batch, where its chunks begin and end, number of the first). Chunks are numbered by partition and place."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        cut = common.edges(batch, batch.num_rows, size)
        yield batch, cut, number
        number += len(cut) - 1


def whole(batch: pa.RecordBatch) -> pa.StructArray:
    return pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """docs as (chunk, rows): an array of whole rows."""

    def run(batches):
        for batch, cut, number in numbered(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(cut) - 1), pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), whole(batch))], names=["chunk", "rows"])

    return docs.mapInArrow(run, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(docs.schema))]))


def texts(rows: pa.StructArray) -> list[bytes]:
    return common.bytes_of(rows.field("text"))


class Chunk:
    """The windows of a chunk, one text after the other."""

    def __init__(self, rows: pa.StructArray, space: int):
        self.words = [Words(t) for t in texts(rows)]
        h = [w.windows() for w in self.words]
        self.edge = np.cumsum([0, *map(len, h)])  # where each text's windows begin
        self.cells, self.inverse, self.counts = np.unique(cells(np.concatenate(h), space), return_inverse=True, return_counts=True)
        self.inverse = self.inverse.reshape(DEPTH, -1)

    def suspects(self, answers, width: int) -> list[np.ndarray]:
        """For each text the windows with an estimate of 2 or more, by the blocks' answers."""
        told = {a["block"]: a["bits"] for a in answers or ()}
        full = np.zeros(len(self.cells), bool)
        for block, at in parts(self.cells, width):
            if block in told:
                full[at] = unbits(told[block], at.stop - at.start)
        hit = np.flatnonzero(full[self.inverse].all(axis=0))
        cut = np.searchsorted(hit, self.edge)
        return [hit[a:b] - e for a, b, e in zip(cut, cut[1:], self.edge)]


class Asked:
    """The suspect windows of a chunk by their digests: what is asked of the blocks, and how answers are read."""

    def __init__(self, chunk: Chunk, answers, width: int, blocks: int):
        first: dict[bytes, int] = {}
        self.at = chunk.suspects(answers, width)
        self.ids = [np.array([first.setdefault(d, len(first)) for d in w.digests(at)], np.int64) for w, at in zip(chunk.words, self.at)]
        count = np.bincount(np.concatenate(self.ids), minlength=len(first)) if first else np.zeros(0, np.int64)
        self.digests = np.frombuffer(b"".join(first), "<u8").reshape(-1, 2)
        block = (self.digests[:, 0] % np.uint64(blocks)).astype(np.int64)
        self.order = np.argsort(block, kind="stable")
        self.twice = count > 1
        self.edge = np.searchsorted(block[self.order], np.arange(blocks + 1))

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for b in np.flatnonzero(np.diff(self.edge)).tolist():
            yield b, self.order[self.edge[b] : self.edge[b + 1]]

    def gone(self, chunk: Chunk, answers) -> list[np.ndarray]:
        """For each text, which words lie in a repeated window."""
        told = {a["block"]: a["bits"] for a in answers or ()}
        repeated = np.zeros(len(self.digests), bool)
        for b, at in self.parts():
            if b in told:
                repeated[at] = unbits(told[b], len(at))
        out = []
        for w, at, ids in zip(chunk.words, self.at, self.ids):
            marks = np.zeros(w.n + 1, np.int32)
            at = at[repeated[ids]]
            marks[at] += 1
            marks[at + WINDOW] -= 1
            out.append(np.cumsum(marks[:-1]) > 0)
        return out


# ---- blocks

ASK = "block long, chunk long, what binary, twice binary"
ANSWER = "chunk long, block long, bits binary"


def answered(group: pa.Table, told: list[bytes]) -> pa.Table:
    """Answers without a single yes are left out."""
    keep = [i for i, t in enumerate(told) if any(t)]
    return pa.table({"chunk": group.column("chunk").take(pa.array(keep, pa.int64())), "block": group.column("block").take(pa.array(keep, pa.int64())), "bits": pa.array([told[i] for i in keep], pa.binary())})


def added(width: int):
    """A block of the sketch: all chunks' counters added up, and for each chunk those of its own that reached 2."""

    def run(group: pa.Table) -> pa.Table:
        what, twice = group.column("what").to_pylist(), group.column("twice").to_pylist()
        counters = np.zeros(width, np.uint8)
        for w, t in zip(what, twice):
            at = unpacked(w)
            counters[at] = np.minimum(counters[at] + 1 + unbits(t, len(at)), 2)
        return answered(group, [bits(counters[unpacked(w)] > 1) for w in what])

    return run


def counted(group: pa.Table) -> pa.Table:
    """A block of digests: for each chunk, those that occur twice."""
    what, twice = group.column("what").to_pylist(), group.column("twice").to_pylist()
    sizes = [len(w) // 16 for w in what]
    d = np.frombuffer(b"".join(what), "<u8").reshape(-1, 2)
    weight = 1 + np.concatenate([unbits(t, n) for t, n in zip(twice, sizes)])
    order = np.lexsort((d[:, 1], d[:, 0]))
    new = np.concatenate([[True], (d[order][1:] != d[order][:-1]).any(axis=1)])
    ids = np.cumsum(new) - 1
    several = np.zeros(len(d), bool)
    several[order] = (np.bincount(ids, weights=weight[order]) > 1)[ids]
    edge = np.cumsum([0, *sizes])
    return answered(group, [bits(several[a:b]) for a, b in zip(edge, edge[1:])])


# ---- the whole

def each_chunk(batches, columns: int) -> Iterator[tuple]:
    """(rows, the other columns' values ...) of each row of batches, rows being the second column."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield (batch.column(1)[i].values, batch.column(0)[i].as_py(), *[batch.column(c)[i].as_py() for c in range(2, columns)])


def messages(found) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("what", pa.binary()), ("twice", pa.binary())])
    held = []
    for row in found:
        held.append(row)
        if len(held) >= 4096:
            yield common.batch_of(schema, **{c: [r[i] for r in held] for i, c in enumerate(schema.names)})
            held = []
    if held:
        yield common.batch_of(schema, **{c: [r[i] for r in held] for i, c in enumerate(schema.names)})


def by_chunk(answers: DataFrame, key: str, name: str) -> DataFrame:
    """All answers to a chunk, as many as there are blocks at most."""
    return answers.groupBy(F.col("chunk").alias(key)).agg(F.collect_list(F.struct("block", "bits")).alias(name))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts. There is about one window for each six; the sketch reckons with one for four."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def applied(docs: DataFrame, out: T.StructType | str, rewritten, size: int = 0, width: int = 0) -> DataFrame:
    """rewritten(rows, words, gone) for each chunk of docs; gone: which words of each row to remove."""
    docs = common.settled(docs, "docs")
    size_of_all, width = text_bytes(docs), width or WIDTH
    size = size or CHUNK
    # a small table gets blocks of less than width, so that all cores have some
    space = max(1 << 14, COUNTERS * (size_of_all // 4))
    width = min(width, 1 << max(10, (space // 32).bit_length()))
    blocks = -(-space // width)
    blocks += -blocks % DEPTH
    space = blocks * width

    def sketched(batches):
        for batch, cut, number in numbered(batches, size):  # the same rows in the same batches as in chunked()
            for i, (a, b) in enumerate(zip(cut, cut[1:])):
                c = Chunk(whole(batch.slice(a, b - a)), space)
                for block, at in parts(c.cells, width):
                    yield block, number + i, packed(c.cells[at] - np.uint64(block * width)), bits(c.counts[at] > 1)

    def asked(batches):
        for rows, chunk, answers in each_chunk(batches, 3):
            if not answers:
                continue
            a = Asked(Chunk(rows, space), answers, width, blocks)
            for block, at in a.parts():
                yield block, chunk, a.digests[at].tobytes(), bits(a.twice[at])

    def finished(batches):
        for rows, _, answers, exact in each_chunk(batches, 4):
            if exact:
                c = Chunk(rows, space)
                yield rewritten(rows, c.words, Asked(c, answers, width, blocks).gone(c, exact))
            else:
                words = [Words(t) for t in texts(rows)]
                yield rewritten(rows, words, [np.zeros(w.n, bool) for w in words])

    chunks = chunked(docs, size)
    sketch = docs.mapInArrow(lambda b: messages(sketched(b)), ASK).groupBy("block").applyInArrow(added(width), ANSWER)
    reached = by_chunk(common.stored(sketch, "reached"), "r_chunk", "reached").hint("merge")
    # All columns go along in both uses, so that both read one and the same exchange of the texts.
    known = chunks.join(reached, chunks.chunk == reached.r_chunk, "left_outer").select("chunk", "rows", "reached")
    exact = known.mapInArrow(lambda b: messages(asked(b)), ASK).groupBy("block").applyInArrow(counted, ANSWER)
    exact = by_chunk(exact, "e_chunk", "exact").hint("merge")
    done = known.join(exact, known.chunk == exact.e_chunk, "left_outer").select("chunk", "rows", "reached", "exact")
    return done.mapInArrow(finished, out)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(docs: DataFrame, **sizes) -> DataFrame:
    """One row per row of docs: words, words removed, and the digest of what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def rewritten(rows, words, gone):
        return common.batch_of(schema, doc_id=rows.field("doc_id"), n_words=[w.n for w in words], n_removed=[int(g.sum()) for g in gone], kept_sha256=[hashlib.sha256(w.without(g)).hexdigest() for w, g in zip(words, gone)])

    return applied(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCHEMA, rewritten, **sizes)


def removed(docs: DataFrame, **sizes) -> DataFrame:
    """docs with repeated words cut out of text. Texts that lose nothing stay as they are; in
    others the kept words are joined by one space; rows left without a word are dropped."""

    def rewritten(rows, words, gone):
        text = rows.field("text")
        new = text.to_pylist()
        for i, (w, g) in enumerate(zip(words, gone)):
            if g.any():
                new[i] = w.without(g).decode()
        keep = pa.array([not (g.any() and not t) for t, g in zip(new, gone)], pa.bool_())
        columns = [pa.array(new, text.type) if f.name == "text" else rows.field(i) for i, f in enumerate(rows.type)]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(rows.type))).filter(keep)

    return applied(docs, docs.schema, rewritten, **sizes)


def sql() -> str:
    """digest() in DuckDB's SQL, by the words of the windows themselves."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    windows AS (SELECT i, s, count(*) OVER (PARTITION BY array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS n FROM (SELECT i, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d)),
    gone AS (SELECT DISTINCT i, unnest(range(s, s + {WINDOW})) AS j FROM windows WHERE n > 1),
    words AS (SELECT i, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
    left_over AS (SELECT words.i, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS kept FROM words LEFT JOIN gone ON gone.i = words.i AND gone.j = words.j GROUP BY words.i)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over ON left_over.i = d.i"""

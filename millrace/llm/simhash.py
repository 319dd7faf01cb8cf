"""SimHash near-dedup by a segment-popcount embedding.

Fingerprints: words of the text with A-Z lower-cased, SHINGLE-word shingles with repeats,
XXH64 (seed 42) of each; a bit is set if it is set in over half of the hashes.

Links join fingerprints that differ in at most NEAR bits. A fingerprint is cut into segments and mapped to
their bit counts, all in one word (the vector of counts, as one 64-bit number). The Manhattan distance
of two vectors is never over the number of differing bits, so of `parts` runs of segments at most NEAR differ:

- the grid: a cell for each choice of parts - NEAR runs, whose counts agree exactly in it;
- the range: within a cell, fingerprints are sorted by the bit count of the other runs, and only those at most NEAR
  apart in it meet; of these, those whose Manhattan distance over the other runs is at most NEAR are candidates;
- candidates are compared bit by bit.

Segments and runs are chosen from the number of fingerprints, so that CELL of them share a cell by chance: a finer
grid costs more cells for each, and the candidates of one stay bounded by cells times CELL as the data grow. The
result is the same with any grid. Cells of over MOST fingerprints are split, and each pair of their blocks meets
in a task of its own, so no task holds more than two blocks of a cell; cells of one are dropped before they move. Only links
of a spanning forest leave a task, so a large group of near copies gives about as many links as members.
No cell holds documents: each distinct fingerprint is in it once.

Defined results: texts without words have fingerprint zero and link like any other; fewer
words than SHINGLE form one shingle; a null text is empty; copies, repeated rows and ties
share a fingerprint; component_id is null only if all ids in the component are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common
from millrace.llm.components import components

SHINGLE, SEED, NEAR = 3, 42, 3
#: Grids from coarse to fine: bits of a segment, runs of segments. Their cells' keys hold about 8, 12, 18, 22, 25 and 30
#: bits of information (a 4-bit segment's count has 2.03, a 2-bit segment's 1.5).
GRIDS = ((4, 4, 8), (2, 4, 12), (2, 5, 18), (2, 6, 22), (2, 7, 25), (2, 8, 30))
#: Fingerprints that share a cell by chance; those that a block of a cell holds at most, about; entries of one task, about.
CELL, MOST, ENTRIES = 8, 20_000, 200_000


def fingerprint(data: bytes, hash_=xxhash.xxh64_intdigest) -> int:
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return hash_(b" ".join(words), SEED)
    h = np.array([hash_(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:])], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame, text_of, keep: int) -> DataFrame:
    """The first `keep` columns of rows and fp, a signed long; no exchange."""

    def run(batches):
        for batch in common.slices(batches):
            fp = np.array([fingerprint(t) for t in common.bytes_of(text_of(batch))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(common.signed(fp))], schema=pa.schema([*list(batch.schema)[:keep], pa.field("fp", pa.int64())]))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:keep], T.StructField("fp", T.LongType())]))


#: Every second bit, and every second pair of bits.
ODD, PAIRS = 0x5555555555555555, 0x3333333333333333


class Grid:
    """The segments, runs and cells of one grid."""

    def __init__(self, segment: int, parts: int):
        self.segment, self.parts = segment, parts
        edge = [round(i * (64 // segment) / parts) * segment for i in range(parts + 1)]
        self.runs = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edge, edge[1:])]
        #: For each kind of cell: the mask of the runs that agree, and the other runs' masks.
        self.kinds = [(sum(self.runs[i] for i in same), [r for i, r in enumerate(self.runs) if i not in same]) for same in itertools.combinations(range(parts), parts - NEAR)]

    def embedded(self, fp: Column) -> Column:
        """The bit counts of all segments, each in its segment's place."""
        low = lambda c, mask: c.bitwiseAND(F.lit(mask))
        after = F.shiftrightunsigned(fp, 1)
        # of two bits: both set is 2, one set is 1; without a subtraction, which could overflow
        two = F.shiftleft(low(fp.bitwiseAND(after), ODD), 1).bitwiseOR(low(fp.bitwiseXOR(after), ODD))
        return two if self.segment == 2 else low(two, PAIRS) + low(F.shiftrightunsigned(two, 2), PAIRS)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_for(n: int) -> Grid:
    return Grid(*next((g for g in GRIDS if n <= CELL << g[2]), GRIDS[-1])[:2])


def cells(distinct: DataFrame, grid: Grid) -> DataFrame:
    """(kind, key, fp): the cells of each fingerprint, as expressions."""
    point = grid.embedded(F.col("fp"))
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("point").bitwiseAND(F.lit(signed(mask))).alias("key")) for i, (mask, _) in enumerate(grid.kinds)])
    return distinct.select("fp", point.alias("point")).select("fp", F.explode(each).alias("x")).select("x.kind", "x.key", "fp")


class Forest:
    """Which of n nodes are joined; the links that joined them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, first = np.unique(high, return_index=True)  # one link for each root that gives way
            self.root[high[first]] = low[first]
            self.links.append((a[first], b[first]))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def met(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, crossed: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (a, b) of a spanning forest of the fingerprints that meet in cells, and how many pairs were candidates.

    cell: a number for each cell or pair of blocks; in crossed ones only entries of different sides meet; rest: the masks of
    the other runs, for each entry. Sorted by cell and the rest's bit count, the entries that can meet an entry
    follow it, up to a distance that is found by trying: those still in reach get fewer with each step."""
    total = sum(np.bitwise_count(fp & m).astype(np.int64) for m in rest)
    order = np.lexsort((total, cell))
    fp, cell, side, crossed, total, rest = fp[order], cell[order], side[order], crossed[order], total[order], [m[order] for m in rest]
    count = [np.bitwise_count(fp & m).astype(np.int8) for m in rest]
    known, node = np.unique(fp, return_inverse=True)
    forest, tried = Forest(len(known)), 0
    alive, step = np.arange(len(fp)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(fp)]
        other = alive + step
        near = (cell[alive] == cell[other]) & (total[other] - total[alive] <= NEAR)
        alive, other = alive[near], other[near]
        able = (~crossed[alive] | (side[alive] != side[other])) & (forest.root[node[alive]] != forest.root[node[other]])
        a, b = alive[able], other[able]
        distance = sum(np.abs(c[a] - c[b]) for c in count)  # Manhattan: a lower bound of the differing bits
        a, b = a[distance <= NEAR], b[distance <= NEAR]
        tried += len(a)
        same = np.bitwise_count(fp[a] ^ fp[b]) <= NEAR
        forest.join(node[a[same]], node[b[same]])
    a, b = (np.concatenate([x[i] for x in forest.links] or [np.zeros(0, np.int64)]) for i in (0, 1))
    return known[a], known[b], tried


def links(distinct: DataFrame, n: int, most: int = 0, grid: Grid | None = None) -> DataFrame:
    """(a, b): links that connect all fingerprints within NEAR bits of each other. distinct: column fp, each once, a table; n: how many."""
    grid, most = grid or grid_for(n), most or MOST
    every = cells(distinct, grid)
    shared = every.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A cell of n is cut into k blocks; block i meets each block j, in the task of (least, greatest). k = 1 for most cells.
    cut = every.join(shared, ["kind", "key"]).select("kind", "key", "fp", F.ceil(F.col("n") / most).cast("int").alias("k"))
    cut = cut.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = cut.select("kind", "fp", "side", F.xxhash64("kind", "key", F.least("side", "j"), F.greatest("side", "j")).alias("cell"), (F.col("side") != F.col("j")).alias("moved"))
    tasks = max(16, n * len(grid.kinds) // ENTRIES)
    masks = np.array([other for _, other in grid.kinds], np.uint64)

    def run(group: pa.Table) -> pa.Table:
        kind, side, cell, moved = (group.column(c).to_numpy() for c in ("kind", "side", "cell", "moved"))
        fp = common.unsigned(group.column("fp").to_numpy().copy())
        # a pair of different blocks has entries with `moved` set; all of it is crossed then
        _, ids = np.unique(cell, return_inverse=True)
        crossed = np.bincount(ids, weights=moved.astype(np.float64))[ids] > 0
        a, b, _ = met(fp, cell, side, crossed, [masks[kind, i] for i in range(masks.shape[1])])
        return pa.table({"a": pa.array(common.signed(a), pa.int64()), "b": pa.array(common.signed(b), pa.int64())})

    return pair.groupBy(F.pmod("cell", F.lit(tasks)).alias("task")).applyInArrow(run, "a long, b long")


def labelled(prints: DataFrame, *first: str) -> DataFrame:
    """fp, first (the least row of the fingerprint by doc_id, nulls last, then the columns of `first`) and root (the component's, a fingerprint)."""
    each = common.stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("v"), "doc_id", *first)).alias("first")), "distinct")
    roots = components(links(each.select("fp"), each.count()))
    return each.join(roots, each.fp == roots.node, "left_outer").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = common.stored(fingerprints(rows, lambda batch: batch.column(1), 1), "fingerprints")
    each = common.stored(labelled(prints), "labelled")
    first = each.groupBy("root").agg(F.min("first").alias("x")).select(F.col("root").alias("r"), F.col("x.doc_id").alias("component_id"))
    ids = each.join(first, each.root == first.r).select(F.col("fp").alias("f"), "component_id")
    return prints.join(ids, prints.fp == ids.f).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of its least doc_id; all columns stay. Of several rows with that id the one with
    the least fingerprint stays, then the first as the table was read.

    Rows are numbered by partition and place, alike in both scans, and the chosen numbers are looked up, which
    exchanges the rows once."""
    docs, name = common.settled(docs, "docs"), common.free_name(docs, "__number")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    prints = common.stored(fingerprints(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("number"), "text"), lambda batch: batch.column(2), 2), "fingerprints")
    each = labelled(prints, "number")
    chosen = common.stored(each.groupBy("root").agg(F.min("first").alias("x")).select(F.col("x.number").alias(name)), "chosen")
    # Sorted and merged at every size: the chosen grow with the documents, so there is no bound to broadcast them by.
    return rows.join(chosen.hint("merge"), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

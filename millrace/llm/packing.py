"""Order-preserving packing of token streams by dynamic programming.

Documents are tokenised and followed by a separator id; the stream of a partition is cut
into sequences of at most LENGTH tokens. Cuts are allowed at document ends and sentence
ends, and, at a higher penalty, every STRIDE tokens inside a longer sentence. With
``best[j]`` the least cost of packing the first j tokens,

    best[j] = penalty(j) + min over i in [j - LENGTH, j) of best[i] + padding(j - i) + OPENING

where padding(n) is LENGTH - n, or 0 if n is a power of two that counts, and penalty(j) is 0 at a
document's end, SENTENCE at a sentence's end and MID elsewhere. As LENGTH - (j - i) is
linear, the minimum is that of ``best[i] + i`` over a sliding window, kept in a monotone
queue: linear time in the number of allowed cuts. The powers of two are tried one by one, down
to a quarter of a sequence: shorter ones would save padding by making more sequences.

The stream is packed in blocks of BLOCK tokens; the last sequence of a block is carried
into the next, so memory is bounded and only a partition's last sequence ends with it.
Order within a partition is kept; there is no exchange.

Defined results: a null or empty text is its separator alone; repeated rows are packed
alike, each once; a document of any length is cut into pieces; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm import common
from millrace.llm.pieces import MIXED_SPACE, Remembered, classes

LENGTH, BLOCK = 1024, 1 << 18
SENTENCE, MID, OPENING = 2, 6, 32
#: A sentence longer than this many tokens may also be cut inside, every so many tokens.
STRIDE = 12
SPECIAL = "<|endoftext|>"
#: Units whose ids a worker remembers.
REMEMBERED = 400_000
#: Characters from which a text is split outside the library.
LONG = 50_000


class Tokenizer:
    """Ids as the tokenizers library gives them, by tiktoken on the same ranks. Text between
    single spaces is looked up unit by unit: where every run of white space that holds a
    space is one space, the splitting pattern never crosses from one unit to the next."""

    def __init__(self, ranks_path: str, pattern: str, special_id: int):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special, self.pattern, self.exact = np.array([special_id], "<u4").tobytes(), pattern, None
        self.units = Remembered(lambda unit: self.whole(" " + unit), REMEMBERED)
        ends = [x.rstrip(b" \n\r\t")[-1:] in (b".", b"!", b"?") or x[-1:] == b"\n" for x in sorted(ranks, key=ranks.get)]
        starts = [x[:1] in (b" ", b"\n") for x in sorted(ranks, key=ranks.get)]
        self.ends, self.starts = np.array(ends + [False]), np.array(starts + [True])

    def ordinary(self, text: str) -> bytes:
        if len(text) <= LONG:
            return np.array(self.core.encode_ordinary(text), "<u4").tobytes()
        # The library's matcher may run out of stack in a very long piece; its merges don't.
        if self.exact is None:
            self.exact, *_ = classes(self.pattern)
        return b"".join(np.array(self.core._encode_single_piece(x), "<u4").tobytes() for x in self.exact(text))

    def whole(self, text: str) -> bytes:
        return self.special.join(map(self.ordinary, text.split(SPECIAL)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if SPECIAL in text or MIXED_SPACE.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.units.__getitem__, rest))


_tokenizers: dict[tuple, Tokenizer] = {}


def tokenizer(ranks_path: str, pattern: str, special_id: int) -> Tokenizer:
    """The worker's own, made once."""
    key = (ranks_path, pattern, special_id)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(*key)
    return _tokenizers[key]


def charged(n: int, length: int = LENGTH) -> int:
    """Padding that a sequence of n tokens is charged."""
    return 0 if n in (length, length >> 1, length >> 2) else length - n


def cuts(points: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """The chosen cut places, ascending, the last being points[-1].

    points: allowed places, ascending, from 0, no gap over length; costs: what a cut there costs."""
    n, half, quarter = len(points), length >> 1, length >> 2
    places = np.full(points[-1] + 1, -1)
    places[points] = np.arange(n)
    place, charge = places.tolist(), [c + OPENING for c in costs]
    best, back, key = [0] * n, [0] * n, [0] * n  # key: best plus place
    queue: deque[int] = deque([0])
    for j in range(1, n):
        at = points[j]
        low = at - length
        source = queue[0]
        while points[source] < low:
            queue.popleft()
            source = queue[0]
        least = key[source] - low
        if at >= half:
            i = place[at - half]
            if i >= 0 and best[i] < least:
                least, source = best[i], i
        if at >= quarter:
            i = place[at - quarter]
            if i >= 0 and best[i] < least:
                least, source = best[i], i
        best[j] = least = least + charge[j]
        back[j] = source
        key[j] = mine = least + at
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(points[j])
        j = back[j]
    return out[::-1]


def allowed(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Allowed cuts of a stream and their costs; doc_ends: places after each document."""
    sentence = np.flatnonzero(ends[ids[:-1]] & starts[ids[1:]]) + 1
    points = np.union1d(sentence, np.concatenate([[0], doc_ends]))
    points = points if points[-1] == len(ids) else np.append(points, len(ids))
    step = min(STRIDE, length)
    gap = np.diff(points)
    extra = (gap - 1) // step  # cuts inside each gap
    if extra.any():
        first = np.cumsum(extra) - extra
        inside = np.repeat(points[:-1], extra) + step * (np.arange(extra.sum()) - np.repeat(first, extra) + 1)
        points = np.sort(np.concatenate([points, inside]))
    cost = np.full(len(points), MID)
    cost[np.isin(points, sentence, assume_unique=True)] = SENTENCE
    cost[np.isin(points, doc_ends, assume_unique=True)] = 0
    return points.tolist(), cost.tolist()


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Packer:
    """Takes documents in order, gives rows of SCHEMA; keeps one block at most."""

    def __init__(self, tok: Tokenizer, first: int, separator: int = 0, length: int = LENGTH, block: int = BLOCK):
        self.tok, self.next, self.length, self.block = tok, first, length, block
        self.end = np.array([separator], "<u4").tobytes()
        self.parts: list[bytes] = []
        self.docs: list[list] = []  # doc_id, tokens, first token of it that is in the buffer
        self.held = 0

    def add(self, doc_id, text: str):
        ids = self.tok.encode(text) + self.end
        n = len(ids) // 4
        at = 0
        while at < n:  # a long document enters in parts
            take = min(n - at, self.block)
            self.parts.append(ids[4 * at : 4 * (at + take)])
            self.docs.append([doc_id, n, at, take])
            self.held += take
            at += take
            if self.held >= self.block:
                yield from self.pack(last=False)

    def pack(self, last: bool):
        if not self.held:
            return
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        edges = np.cumsum([d[3] for d in self.docs])
        done = np.array([d[2] + d[3] == d[1] for d in self.docs])
        points, costs = allowed(ids, edges[done] if done.any() else np.zeros(0, np.int64), self.tok.ends, self.tok.starts, self.length)
        chosen = cuts(points, costs, self.length)
        if not last and len(chosen) > 1:
            chosen = chosen[:-1]
        out = {c: [] for c in ARROW.names}
        d, begun = 0, 0  # the document at hand, and where it begins in the buffer
        at = 0
        raw = ids.tobytes()
        for end in chosen:
            offset = 0
            while at < end:
                doc_id, total, first, here = self.docs[d]
                stop = min(end, begun + here)
                row = (doc_id, first + at - begun, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), total, self.next, offset)
                for c, v in zip(ARROW.names, row):
                    out[c].append(v)
                offset += stop - at
                at = stop
                if stop == begun + here:
                    begun += here
                    d += 1
            self.next += 1
        rest = self.docs[d:]
        if rest and at > begun:
            rest[0] = [rest[0][0], rest[0][1], rest[0][2] + at - begun, rest[0][3] - (at - begun)]
        self.docs, self.parts, self.held = rest, [raw[4 * at :]] if at < len(ids) else [], len(ids) - at
        yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in ARROW.names], schema=ARROW)


def pack(docs: DataFrame, ranks_path: str, pattern: str, special_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece. sequence_id is the partition's number times 2**40 plus a count, so it is unique."""

    def run(batches):
        packer = Packer(tokenizer(ranks_path, pattern, special_id), TaskContext.get().partitionId() << 40, length=length)
        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1))):
                yield from packer.add(doc_id, text)
        yield from packer.pack(last=True)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)

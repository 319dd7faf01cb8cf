"""Byte-level BPE by backtracking over longest matches.

Tokens are mapped to Latin-1 strings, byte by byte, and put into an Aho-Corasick automaton,
whose one pass over a piece gives the longest token that begins at each byte. The encoder
takes the longest token that is compatible with its left neighbour, falls back to shorter
prefixes, and steps back when none fits. Two tokens are compatible if merging their joined
bytes by rank gives just these two; that is found by walking their merge trees and memoised.
The outcome is exactly that of the merges, in time linear in the piece.

Pieces are the matches of the splitting pattern, each encoded alone. A text whose white space
is single spaces and line ends is looked up between spaces, as no match crosses from one such
unit into the next.

Defined results: null and empty texts have no ids; texts and pieces of any length are encoded
whole; special-token strings in a text are ordinary text; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm import common
from millrace.llm.pieces import MIXED_SPACE, Remembered, classes

#: Units, pieces and pairs of tokens that a worker remembers.
UNITS, PIECES, PAIRS = 250_000, 400_000, 500_000
LIMIT = 1 << 62


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.pieces = regex.compile(pattern).findall
        self.exact, self.odd, self.first_odd = classes(pattern)
        self.split: list[tuple[int, int]] = [(-1, -1)] * len(self.tokens)
        self.pair: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * len(self.tokens)
        self.fits = Remembered(lambda pair: self.compatible(*pair), PAIRS)
        self.sizes = list(map(len, self.tokens))
        self.piece_ids = Remembered(lambda piece: packed(self.merged(piece.encode())), PIECES)
        self.unit_ids = Remembered(lambda unit: self.ordinary(" " + unit), UNITS)
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if self.learn(token, i):
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    def learn(self, token: bytes, i: int) -> bool:
        """Finds the two tokens that i is merged from; False if merging never gives i."""
        if len(token) == 1:
            self.split[i] = (i, i)
            return True
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n], LIMIT), self.ranks.get(token[n:], LIMIT)
            if a < i and b < i and self.split[a][0] >= 0 and self.split[b][0] >= 0 and self.compatible(a, b):
                self.pair[a, b] = i
                self.split[i] = (a, b)
                break
        else:
            return False
        return True

    def prefix(self, i: int) -> int:
        """The longest shorter token that i begins with; -2: none."""
        if self.shorter[i] == -1:
            token = self.tokens[i]
            self.shorter[i] = next((x for n in range(len(token) - 1, 0, -1) if (x := self.ranks.get(token[:n], -1)) >= 0 and self.split[x][0] >= 0), -2)
        return self.shorter[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined bytes of tokens a and b are merged to just a, b."""
        pair, split, limit = self.pair, self.split, LIMIT
        while True:
            if pair.get((a, b), LIMIT) < limit:
                return False
            # Undo the later of the two merges on the side that touches the border.
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, fits = len(piece), self.fits
        longest, sizes = [-1] * n, self.sizes
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end - sizes[i] + 1] = i  # of those that begin at one byte, the longest ends last
        out, at, dead = [], 0, bytearray(n + 1)
        token, last = longest[0], -1
        while True:
            while token >= 0:
                end = at + sizes[token]
                if not dead[end] and (last < 0 or fits[last, token]):
                    break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            else:  # nothing fits here: never come back, and shorten the token before
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = self.prefix(token)

    def ordinary(self, text: str) -> bytes:
        """Ids of any text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.piece_ids.__getitem__, self.exact(text) if text and max(text) >= self.first_odd and self.odd(text) else self.pieces(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if MIXED_SPACE.search(text):
            return self.ordinary(text)
        head, *rest = text.split(" ")
        return self.ordinary(head) + b"".join(map(self.unit_ids.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The worker's own, made once."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        with open(ranks_path, "rb") as f:
            _encoders[key] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
    return _encoders[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: number of ids, digests of the ids and of what they decode to. No exchange."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        e = encoder(ranks_path, pattern)
        for batch in common.slices(batches):
            ids = [e.encode(t) for t in common.texts_of(batch.column(1))]
            yield common.batch_of(
                schema, doc_id=batch.column(0), n_tokens=[len(x) // 4 for x in ids],
                ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids], decoded_sha256=[hashlib.sha256(e.decode(x)).hexdigest() for x in ids],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, an array of ids, in place of text_col."""
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in rest]).schema] + [f"`{ids_col}` array<int>"])

    def run(batches):
        e = encoder(ranks_path, pattern)
        for batch in common.slices(batches):
            ids = [np.frombuffer(e.encode(t), "<i4") for t in common.texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(ids, pa.list_(pa.int32()))], schema=pa.schema(list(batch.schema)[:-1] + [pa.field(ids_col, pa.list_(pa.int32()))]))

    return docs.select(*[f"`{c}`" for c in rest], f"`{text_col}`").mapInArrow(run, schema)

"""Plain versions of the operators, written from their contracts, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def secrets(text: str | None) -> tuple:
    text = text or ""
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    n = Counter(k for _, k, _ in found)
    kinds = ("assign", "access", "hex")
    return n[0], n[1], n[2], sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)))


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    hit = {i + d for p in places.values() if len(p) > 1 for i in p for d in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def substrings(rows: list[tuple], size: int = 35) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if n[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def simhash(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple], near: int = 3) -> dict:
    """doc_id -> (fingerprint, component)."""
    by = defaultdict(list)
    for doc_id, text in rows:
        by[simhash(text)].append(doc_id)
    fps, root = list(by), {f: f for f in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= near:
                root[find(a)] = find(b)
    least = {}
    for f, ids in by.items():
        least[find(f)] = min([*ids, *([least[find(f)]] if find(f) in least else [])])
    return {d: (f"{f:016x}", least[find(f)]) for f, ids in by.items() for d in ids}


def gram_hash(gram: str) -> int:
    """The upper half of a polynomial of the code points, each plus 1, modulo 2**64, after a multiplication."""
    value = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, c in enumerate(gram))
    return value * 0xBF58476D1CE4E5B9 % (1 << 64) >> 32


def winnow(text: str, gram: int, window: int) -> list[tuple[int, int]]:
    h = [gram_hash(text[i : i + gram]) for i in range(max(1, len(text) - gram + 1))] if text else []
    out = []
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = h[i : i + window]
        least = min(part)
        at = i + max(j for j, x in enumerate(part) if x == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out


def toxic_words(text: str | None) -> list[bytes]:
    """Words between white space and ASCII punctuation, A-Z lower-cased, as bytes."""
    return re.sub(rb"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", b" ", (text or "").encode().lower()).split()


def toxicity(text: str | None, lexicon: dict[bytes, float], rate: float, k: float, weights: tuple, drift: float, significant: float) -> tuple[float, int]:
    """Score and significant passages: each word's best feature by trying all, segments by segments()."""
    scores = []
    for w in toxic_words(text):
        known = [x for f, x in lexicon.items() if f == w + b" " or (len(f) < len(w) and f[-1:] != b" " and w.startswith(f))]
        scores.append(max(known) - drift if known else -drift)
    logs = [rate * sum(scores[a : b + 1]) - math.log(k * len(scores)) for a, b in segments(scores)]
    best, n = min(40.0, max(0.0, max(logs, default=0.0))), sum(x > -math.log(significant) for x in logs)
    z = weights[0] + weights[1] * best + weights[2] * math.log(1 + n)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def crc(data: bytes | str) -> int:
    return zlib.crc32(data.encode() if isinstance(data, str) else data)


def best_packing(n: int, points: dict[int, int], length: int, opening: int) -> int:
    """Least cost of cutting n tokens at points (place -> cost), by trying all. A whole sequence,
    half and a quarter of one are charged no padding."""
    best = {0: 0}
    for j in sorted(points):
        if j:
            best[j] = min((best[i] + (0 if j - i in (length, length // 2, length // 4) else length - (j - i)) for i in best if 0 < j - i <= length), default=10**9) + points[j] + opening
    return best[n]


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments: the best one (shortest, leftmost), then those to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    return segments(scores[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in segments(scores[j + 1 :])]

"""How texts are split into pieces before byte-level BPE, as tiktoken's own tables split them."""

from __future__ import annotations

import re

import regex

#: White space in which the pattern could join a unit to the next: a space beside other white space, or at an end.
MIXED_SPACE = re.compile(r"\s |[ ](?:\s|$)|^ ")


def classes(pattern: str):
    """(splitter with the code points that tiktoken's own tables have in place of the pattern's
    classes, search for code points that the regex library classes otherwise, the first of those). Libraries follow
    different versions of Unicode; a text without such a code point is split alike by both."""
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own, other = {}, set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        if name not in pattern:
            continue
        # encode_ordinary() drops what its pattern doesn't match
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = set(probe.decode_bytes(probe.encode_ordinary(everything)).decode())
        other |= found ^ set(regex.findall(name, everything))
        own[name] = ranges(found)
    exact, depth, i = "", 0, 0
    while i < len(pattern):
        name = next((n for n in own if pattern.startswith(n, i)), None)
        if name:
            exact += own[name] if depth else f"[{own[name]}]"
            i += len(name)
        elif pattern.startswith(r"\S", i) and r"\s" in own and not depth:
            exact += rf"[^{own[chr(92) + 's']}]"
            i += 2
        else:
            step = 2 if pattern[i] == "\\" else 1
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            exact += pattern[i : i + step]
            i += step
    return regex.compile(exact).findall, re.compile(f"[{ranges(other)}]" if other else r"(?!)").search, min(other, default="\U0010ffff")


def ranges(chars: set[str]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Remembered(dict):
    """make(key) for keys used lately, in two generations of `most` keys: when the younger is full
    it becomes the older, whose keys come back when they are asked for. Long keys are not kept."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

"""Vectorised 64-bit hashing that several operators share."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the final mixing.
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i under n; base is odd. Short tables are remembered."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, table = 1 << max(10, (n - 1).bit_length()), []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            table.append(np.multiply.accumulate(step))
        if size > 1 << 20:
            return table[0][:n], table[1][:n]
        _powers[base] = table[0], table[1]
    up, down = _powers[base]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))

"""Fingerprints of any stretch of bytes from prefix polynomials, and exact comparison of many stretches at once."""

from __future__ import annotations

import numpy as np

from basketline.llm.text import _power_tables, mix

#: a random-looking odd value for each byte
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Prefixes:
    """Prefix sums of a polynomial over bytes: the fingerprint of any stretch in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of data[starts:ends], the same wherever the stretch stands."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one after the other."""
    total = np.cumsum(lengths)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """Which stretches data[a:a + length] and data[b:b + length] are not the same, byte by byte."""
    out, row = np.zeros(len(a), bool), 0
    total = np.cumsum(lengths)
    while row < len(a):
        done = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, done + at_once, "right")))
        n = lengths[row:end]
        wrong = data[ragged(a[row:end], n)] != data[ragged(b[row:end], n)]
        out[row:end][np.repeat(np.arange(end - row), n)[wrong]] = True
        row = end
    return out

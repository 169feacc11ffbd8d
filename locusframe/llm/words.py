"""Words of texts as 64-bit hashes, in whole numpy arrays.

A word is a maximal run of bytes other than space and \\x09-\\x0D.  Every hash is
a function of the word alone, so all tasks give equal words equal numbers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE, _WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xCA5A826395121157)
    return x ^ (x >> U(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x2545F4914F6CDD1D))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


@lru_cache(maxsize=None)
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(size, b, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=None)
def _powers(base: int) -> Powers:
    return Powers(base)


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every range, by one running sum."""
    up, down = _powers(base).get(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Words:
    """Words of a slice of texts: ``start`` and ``end`` are byte places, ``first`` the first word of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: bool = False):
        inside = ~_SPACE[data]
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = at[:-1][at[:-1] < at[1:]]
        begin[edge] = inside[edge]
        edge = at[1:][at[:-1] < at[1:]] - 1
        last[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        letters = (_FOLDED if fold else _BYTES)[data]
        self.hash = ranges(letters, self.start, self.end, _BASE) ^ mix((self.end - self.start).astype(U))

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k consecutive words of one text, and the word each begins with."""
        n = np.maximum(self.count - k + 1, 0)
        starts = spread(self.first[:-1], n)
        return ranges(self.hash, starts, starts + k, _WORD_BASES[which]), starts


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+count[0]-1, then the same of the next, and so on."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(first - before, count)

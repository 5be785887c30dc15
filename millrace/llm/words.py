"""Words and word hashes of whole texts, in numpy over UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D.  All of these are ASCII, so
a word of the text is a word of its bytes.  A word's 64-bit hash adds one random number per (place in the
word, byte), from a table made by a seeded generator, and is then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SPACE_STR = SPACES.decode()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = 64
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, _PLACES * 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Base of the rolling hash, 5 modulo 8, and its inverse modulo 2^64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes handled at a time inside one very long text.
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``start``, ``end``: byte ranges; ``hash``: 64 bits a word; ``first``: word index at which each row begins (n + 1 long)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, hashes: bool = True) -> Words:
    """Words of the rows ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    solid = ~_IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begin[edge] = solid[edge]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    stop[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, offsets)
    out = np.zeros(len(start) if hashes else 0, np.uint64)
    lo = 0
    while hashes and lo < len(start):
        hi = min(max(int(np.searchsorted(end, start[lo] + _BLOCK, "right")), lo + 1), len(start))
        out[lo:hi] = _hashes(data[start[lo] : end[hi - 1]], start[lo:hi] - start[lo], end[lo:hi] - start[lo])
        lo = hi
    return Words(start, end, out, first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    byte = data[place + np.repeat(start, size)].astype(np.int64)
    value = _TABLE[(place % _PLACES) * 256 + byte]
    if size.max() > _PLACES:  # only the bytes past the table's places, so a word's hash does not depend on its neighbours
        far = np.flatnonzero(place >= _PLACES)
        value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64) * _STEP)
    return mix(np.add.reduceat(value, at[:-1]) + size.astype(np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words within a row, and the word index at which each begins.

    A rolling hash: running sums of the word hashes times powers of an odd base give every window by one subtraction, which the inverse
    power moves to the window's start.  The value is then mixed.
    """
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, total), out=sums[1:])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    fits = np.flatnonzero(left[: total - n + 1] >= n)
    whole = (sums[fits + n] - sums[fits]) * _powers(_INVERSE, total)[fits]
    return mix(whole + np.uint64(n)), fits


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]

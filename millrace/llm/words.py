"""Words, lines and shingles of many texts at once, as arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``. Hashes have 64 bits: two different words,
lines or shingles meet with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the disjoint, ascending byte runs ``[start, end)``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    within = np.arange(total) - np.repeat(first, sizes)
    powers = np.full(int(sizes.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.cumprod(powers)
    values = _BYTE[data[within + np.repeat(starts, sizes)]] * powers[within]
    filled = sizes > 0
    out = np.zeros(len(starts), np.uint64)
    if total:
        out[filled] = np.add.reduceat(values, first[filled])
    return mixed(out + sizes.astype(np.uint64) * _STEP)


class Words:
    """The words of the texts of one slice: ``starts``, ``ends`` (bytes) and ``doc`` (row), in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.docs = data, offsets, len(offsets) - 1
        inside = ~SEPARATOR[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.inside = inside
        self.count = np.bincount(self.doc, minlength=self.docs)

    def hashes(self) -> np.ndarray:
        return hashed_runs(self.data, self.starts, self.ends)

    def shingles(self, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hash, doc, first word)`` of every run of five words in one text, in order.

        ``short``: a text of one to four words gives its whole sequence as one shingle.
        """
        h, n = self.hashes(), len(self.starts)
        width = max(0, n - SHINGLE + 1)
        total = np.zeros(width, np.uint64)
        for k in range(SHINGLE):
            total += h[k : k + width] * _PLACE[k]
        whole = self.doc[:width] == self.doc[SHINGLE - 1 :] if width else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        value, doc = mixed(total[at]), self.doc[at]
        if short and (few := (self.count > 0) & (self.count < SHINGLE)).any():
            first = np.cumsum(self.count) - self.count
            rows = np.flatnonzero(few)
            extra = np.zeros(len(rows), np.uint64)
            for k in range(SHINGLE - 1):
                there = self.count[rows] > k
                extra[there] += h[first[rows[there]] + k] * _PLACE[k]
            value = np.concatenate([value, mixed(extra + self.count[rows].astype(np.uint64))])
            doc, at = np.concatenate([doc, rows]), np.concatenate([at, first[rows]])
        return value, doc, at


def repeats(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: does its value occur again in its group, and did it occur before in it?"""
    order = np.lexsort((value, group))
    v, g = value[order], group[order]
    same = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    again = np.zeros(len(v), bool)
    again[1:] |= same
    earlier = again.copy()
    again[:-1] |= same
    out, seen = np.empty(len(v), bool), np.empty(len(v), bool)
    out[order], seen[order] = again, earlier
    return out, seen

"""Elias-Fano sequences that are queried where they lie in a mapped file.

A sequence of ``n`` non-decreasing numbers below ``u`` keeps the low bits of
each number packed, and the high parts as a bit string in which number ``i`` sets
bit ``high + i``. Counts of ones per word let the ``i``-th one and the ``i``-th
zero be found by a search and one word: about ``2 + log2(u / n)`` bits a number
plus one for the counts. All reads take arrays of queries.
"""

from __future__ import annotations

import numpy as np

#: An unaligned 64-bit window holds this many bits from any bit of its first byte.
MOST_LOW = 56
_HEAD = 5


class EliasFano:
    """``words``: 64-bit little-endian words as ``build`` gives them, read in place."""

    def __init__(self, words: np.ndarray):
        self.n, self.low_bits, low, high, self.most = (int(x) for x in words[:_HEAD])
        at = _HEAD + low
        packed = words[_HEAD:at].view(np.uint8)
        self.windows = np.ndarray(max(len(packed) - 7, 0), "<u8", packed, strides=(1,)) if low else None
        self.high = words[at : at + high]
        self.ones = words[at + high : at + high + (high + 2) // 2].view(np.uint32)[: high + 1]
        self.length = at + high + (high + 2) // 2

    @staticmethod
    def build(values: np.ndarray) -> np.ndarray:
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = min(max((most // max(n, 1)).bit_length() - 1, 0), MOST_LOW)
        packed = []
        for at in range(0, n if low_bits else 0, 1 << 16):  # whole bytes each
            part = values[at : at + (1 << 16), None] >> np.arange(low_bits, dtype=np.uint64)
            packed.append(np.packbits((part & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(8, np.uint8)]) if packed else np.zeros(0, np.uint8)
        low = np.pad(low, (0, -len(low) % 8)).view("<u8")
        bits = np.zeros(-(-(n + (most >> low_bits) + 1) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        ones = np.pad(ones, (0, len(ones) % 2)).view("<u8")
        head = np.array([n, low_bits, len(low), len(high), most], "<u8")
        return np.concatenate([head, low, high, ones])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the ``k``-th (from 0) one or zero of the bit string."""
        before = self.ones if ones else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(np.int64)
        bits = self.high[word] if ones else ~self.high[word]
        at = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= below
            left = np.where(beyond, left - below, left)
            bits = np.where(beyond, bits >> np.uint64(width), bits)
            at = at + width * beyond
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at the places ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        return (((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)).astype(np.int64)

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per wanted number the place of the first number not below it, and
        whether the two are equal."""
        wanted = np.asarray(wanted).astype(np.uint64)
        place, equal = np.full(len(wanted), self.n), np.zeros(len(wanted), bool)
        inside = np.flatnonzero(wanted <= np.uint64(self.most)) if self.n else np.zeros(0, np.int64)
        if not len(inside):
            return place, equal
        wanted = wanted[inside]
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        end = self._select(high, False) - high  # numbers whose high part is at most this one
        start = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high)
        start[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        left, right = start, end.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) // 2
            small = self._low(middle) < low[open_]
            left[open_[small]] = middle[small] + 1
            right[open_[~small]] = middle[~small]
            open_ = open_[left[open_] < right[open_]]
        hit = np.flatnonzero(left < end)
        found = np.zeros(len(left), bool)
        found[hit] = self._low(left[hit]) == low[hit]
        place[inside], equal[inside] = left, found
        return place, equal


def joined(parts: list[np.ndarray]) -> bytes:
    """Several word arrays as one file: their number, their sizes, then they."""
    head = np.array([len(parts), *map(len, parts)], "<u8")
    return np.concatenate([head, *parts]).tobytes()


def parted(words: np.ndarray) -> list[np.ndarray]:
    """The word arrays of a mapped file, as views."""
    count = int(words[0])
    ends = np.cumsum(words[1 : 1 + count]).astype(np.int64) + 1 + count
    return [words[e - int(s) : e] for e, s in zip(ends, words[1 : 1 + count], strict=True)]

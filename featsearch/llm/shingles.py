"""Word hashes and shingle hashes of whole texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np
import xxhash

from featsearch.llm.common import SPACE

FIVE = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, and words above which a word is hashed by itself:
#: a polynomial modulo 2^64 is weak on very long regular words only.
CHUNK, LONG = 1 << 18, 256
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE.encode())] = False


def scramble(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the MurmurHash3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: A random 64-bit value per byte, by place times the powers of ``_MULT``.
_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWER = np.cumprod(np.full(CHUNK + LONG, _MULT, np.uint64))
_INVERSE = np.cumprod(np.full(CHUNK + LONG, np.uint64(pow(int(_MULT), -1, 1 << 64)), np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word of a UTF-8 text."""
    if len(data) <= CHUNK:
        return _hashed(data)
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data) and IS_WORD[data[stop]]:  # to the end of the word
            stop += 1
        out.append(_hashed(data[at:stop]) if stop - at <= CHUNK + LONG else _one_by_one(data[at:stop]))
        at = stop
    return np.concatenate(out)


def _one_by_one(data: bytes) -> np.ndarray:
    found = [_hashed(w) if len(w) <= LONG else _long(w) for w in data.split()]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _long(word: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(word)], np.uint64)


def _hashed(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = IS_WORD[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=sums[1:])
    hashes = scramble((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = _long(data[starts[i] : ends[i]])[0]
    return hashes


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = scramble(hashes + np.uint64(seed)) if seed else hashes
    out = np.full(n, seed, np.uint64)
    for i in range(width):
        out = (out + base[i : i + n]) * _MULT
        out ^= out >> np.uint64(29)
    return scramble(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_set(text: str | None, width: int = FIVE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased.

    Fewer words than ``width`` make one shingle, no words none.
    """
    hashes = word_hashes((text or "").encode().lower())
    n = len(hashes)
    return distinct(window_hashes(hashes, min(width, n), seed=max(0, width - n))) if n else hashes

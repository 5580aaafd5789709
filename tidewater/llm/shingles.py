"""Hashes of word windows, vectorised per text."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E6C63D0876A9A47)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            table = np.full(max(n, 1024), _FACTOR, dtype=np.uint64)
            table[0] = 1
            _powers = np.multiply.accumulate(table)
    return _powers


def column_words(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow string column, and where each row's begin (one more entry: the end).

    Works on the column's bytes without a Python string for a word: white space
    (which no other UTF-8 character contains) ends words, and a word's hash is a
    polynomial over random values of its bytes. `lower` folds A-Z.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = space[:-1]
    begins[edges[:-1][edges[:-1] < len(data)]] = True
    begins &= ~space
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    first = starts[0]
    owner = np.cumsum(begins[first:], dtype=np.int32) - 1
    place = np.arange(first, len(data)) - starts[owner]
    place[space[first:]] = 0
    with np.errstate(over="ignore"):
        value = _BYTE[data[first:]]
        value *= _power_table(int(place.max()) + 1)[place]
        value[space[first:]] = 0
        hashes = mix(np.add.reduceat(value, starts - first))
    return hashes, np.searchsorted(starts, edges)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes, as uint64."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    w = words
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + w[j : j + n]
    return mix(out, seed + k)


def column_shingles(column, k: int = 5):
    """For each row of an Arrow string column the sorted distinct hashes (int64) of its k-word shingles.

    Fewer words are one shingle; no words are none. A-Z is folded.
    """
    hashes, bounds = column_words(column, lower=True)
    windows = window_hashes(hashes, k).view(np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > k:
            own = np.sort(windows[a : b - k + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        else:
            yield window_hashes(hashes[a:b], b - a).view(np.int64) if b > a else np.zeros(0, np.int64)

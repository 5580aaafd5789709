"""A minimal perfect hash over keys of several 64-bit words, with the keys stored by slot.

Keys are placed level by level: at each level a key whose bit no other key shares is
placed there and its slot is the rank of the bit; the others go on to the next level,
and the few left after the last one are kept in a sorted list. The stored key of the
slot decides whether a key that is looked up is one of the set.
"""

from __future__ import annotations

import numpy as np

from tidewater.llm.shingles import mix

LEVELS, SPREAD = 16, 2


def folded(keys: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words [n, width] as one 64-bit value each."""
    out = np.zeros(len(keys), dtype=np.uint64)
    for c in range(keys.shape[1]):
        out = mix(out ^ keys[:, c].view(np.uint64), 7 + c)
    return out


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys [n, width] of int64."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        left, values = np.arange(len(keys)), folded(keys)
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []  # rank of the first bit of each word of 64
        self.ends: list[int] = []
        slots = np.empty(len(keys), dtype=np.int64)
        used = 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-SPREAD * len(left) // 64) * 64
            at = self._place(values[left], level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            held = np.zeros(size, dtype=bool)
            held[at[alone]] = True
            rank = np.cumsum(held) - held + used
            slots[left[alone]] = rank[at[alone]]
            words = np.packbits(held.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
            self.bits.append(words)
            self.before.append(rank[::64])
            used += int(held.sum())
            left = left[~alone]
        order = np.argsort(values[left], kind="stable")
        self.rest, self.used = values[left][order], used  # found by search; equal values are told apart by the stored key
        slots[left[order]] = used + np.arange(len(left))
        self.keys = np.empty_like(keys)
        self.keys[slots] = keys

    @staticmethod
    def _place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(values, 100 + level) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't of the set."""
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left, values = np.arange(len(keys)), folded(keys)
        for level, (words, before) in enumerate(zip(self.bits, self.before)):
            if not len(left):
                return out
            at = self._place(values[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            self._settle(out, keys, left[here], before[at[here] >> 6] + below.astype(np.int64))
            left = left[~here]
        if len(left) and len(self.rest):
            first = np.searchsorted(self.rest, values[left])
            for step in range(int(np.unique(self.rest, return_counts=True)[1].max())):
                at = np.minimum(first + step, len(self.rest) - 1)
                same = (self.rest[at] == values[left]) & (out[left] < 0)
                self._settle(out, keys, left[same], self.used + at[same])
        return out

    def _settle(self, out: np.ndarray, keys: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> None:
        good = (self.keys[slots] == keys[rows]).all(axis=1)
        out[rows[good]] = slots[good]

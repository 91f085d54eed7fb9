"""A minimal perfect hash in numpy: levels of bit arrays, each of which holds the keys that are alone in their slot.

A key is a pair of 64-bit hashes. ``slots`` gives every member its own number below ``len``; for other keys it gives any
number or -1, so the caller compares a stored fingerprint.
"""

from __future__ import annotations

import numpy as np

_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)
_S = [np.uint64(x) for x in (30, 27, 31)]
#: Slots of a level for each key that it is offered.
ROOM = 2.0


def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    z = high + low * _ODD[2] + np.uint64((level + 1) * int(_ODD[2]) % (1 << 64))
    z = (z ^ (z >> _S[0]) ^ (low << np.uint64(level % 13))) * _ODD[0]
    z = (z ^ (z >> _S[1])) * _ODD[1]
    return ((z ^ (z >> _S[2])) % np.uint64(size)).astype(np.int64)


class MinimalHash:
    def __init__(self, high: np.ndarray, low: np.ndarray):
        """``high``, ``low``: the halves of the keys, without repeated pairs."""
        self.count, self.levels, base = len(high), [], 0
        while len(high):
            size = max(64, int(ROOM * len(high)) // 64 * 64 + 64)
            at = _place(high, low, len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            before = base + np.cumsum(counts) - counts
            self.levels.append((size, words, before))
            base += int(counts.sum())
            high, low = high[~alone], low[~alone]

    def __len__(self) -> int:
        return self.count

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = _place(high[left], low[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (before[at >> 6] + below)[hit]
            left = left[~hit]
        return out

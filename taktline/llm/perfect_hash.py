"""Minimal perfect hash of a bounded key set: levels of bits, one set bit per key, ranks as positions."""

from __future__ import annotations

import numpy as np

from taktline.llm.words import SEED, mix

GAMMA = 1.5  # bits of a level per key that is left
MAX_LEVELS = 500  # distinct 128-bit hashes are placed long before


def key_hashes(keys: np.ndarray, part: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of (key or null, part)."""
    k, p = keys.astype(np.int64).view(np.uint64), part.astype(np.uint64) * np.uint64(2) + absent.astype(np.uint64)
    first = mix(mix(k + SEED) + p * SEED)
    return first, mix(mix(p + SEED) ^ (k * SEED + np.uint64(1)))


def fingerprints(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first + second * SEED) >> np.uint64(32)).astype(np.uint32)


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(first ^ mix(second + np.uint64(level * int(SEED) % 2**64))) % np.uint64(size)


class PerfectHash:
    """Position 0..n-1 of each of the n keys it was built from; some position or -1 for any other key."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.ranks = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> "PerfectHash":
        """Each level takes the keys that are alone in their place; the others go on to the next."""
        sizes, levels = [], []
        while len(first):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys of a perfect hash have to differ")
            size = -(-int(GAMMA * len(first) + 1) // 64) * 64
            place = _place(first, second, len(sizes), size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[place]
            first, second = first[left], second[left]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def index(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        open_ = np.arange(len(first))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self.starts[level] + _place(first[open_], second[open_], level, size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

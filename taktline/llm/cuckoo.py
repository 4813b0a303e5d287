"""A cuckoo filter on numpy arrays: inserts, deletes, and lookups of many keys at once."""

from __future__ import annotations

import numpy as np

from taktline.llm.words import mix

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Fingerprints of 64-bit keys, 16 bits each, four to a bucket. No false negatives; may say yes wrongly."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets  # (number of buckets, a power of two; SLOTS), uint16, 0 is free

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        size = 1 << max(4, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((size, SLOTS), np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys; a larger one if an insert finds no place."""
        n = len(keys)
        while True:
            made = cls.for_keys(n)
            if made.insert(keys):
                return made
            n = max(64, 2 * n)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.buckets) - 1)
        h = mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = h & mask
        return mark, one, one ^ (mix(mark.astype(np.uint64)) & mask)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no place; the filter then has to be built anew, larger."""
        rng = np.random.default_rng(len(keys))
        mask = len(self.buckets) - 1
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for at in (one, two):
                free = np.flatnonzero(self.buckets[at] == 0)
                if len(free):
                    self.buckets[at, free[0]] = mark
                    break
            else:
                at = one
                for _ in range(KICKS):
                    slot = int(rng.integers(SLOTS))
                    mark, self.buckets[at, slot] = int(self.buckets[at, slot]), mark
                    at ^= int(mix(np.array([mark], np.uint64))[0]) & mask
                    free = np.flatnonzero(self.buckets[at] == 0)
                    if len(free):
                        self.buckets[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for at in (one, two):
                there = np.flatnonzero(self.buckets[at] == mark)
                if len(there):
                    self.buckets[at, there[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        mark = mark[:, None]
        return (self.buckets[one.astype(np.int64)] == mark).any(1) | (self.buckets[two.astype(np.int64)] == mark).any(1)

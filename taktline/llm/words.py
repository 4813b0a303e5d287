"""Words of a text and hashes of word runs, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and tab to carriage return: bytes.split() knows just these six."""
    return text.split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` words; the whole sequence as one run if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width_here = min(width, n)
    out = np.full(n - width_here + 1, width_here * int(SEED) % 2**64, np.uint64)
    for j in range(width_here):
        out = mix(out + hashes[j : n - width_here + 1 + j] + SEED)
    return out

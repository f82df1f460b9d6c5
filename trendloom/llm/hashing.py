"""Word and shingle hashes, computed with numpy inside the tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers by position within a shingle or seed.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(i), seed=7) | 1 for i in range(64)],
                       dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CACHED_WORDS = 250_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for the words seen so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def tag(value: int, multiplier: int) -> np.uint64:
    """A small number as the start of a hash, so that kinds differ."""
    return np.uint64(value * int(MULTIPLIERS[multiplier]) & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place where possible)."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of a word-hash sequence, ascending.

    Shorter sequences count as one shingle of their own length; no word, none.
    """
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    count = n - size + 1
    h = np.full(count, tag(size, 63))
    for i in range(size):
        h += words[i:i + count] * MULTIPLIERS[i]
    return np.unique(mix(h))


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark's signed longs."""
    return h.view(np.int64)

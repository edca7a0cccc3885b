"""Word and shingle hashes of texts, vectorised per text."""

from __future__ import annotations

import numpy as np
import xxhash

from hotzone.llm.common import ship

ship(__name__)

CACHE_WORDS = 400_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash by word, cached up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


class Rolling:
    """Hashes of every run of ``n`` consecutive words from the words' hashes."""

    def __init__(self, multiplier: int):
        self.m = U(multiplier)
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inv = U(pow(int(self.m), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, self.m)]))
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, inv)]))
        return self.up[:n], self.down[:n]

    def of(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return h[:0]
        up, down = self.powers(len(h))
        total = np.concatenate([np.zeros(1, U), np.cumsum(h * up, dtype=U)])
        return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


SHINGLE = Rolling(0x9E3779B97F4A7C15)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one
    shingle, an empty one has none."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return SHINGLE.of(h, len(h)) ^ U(len(h))
    return np.unique(SHINGLE.of(h, n))

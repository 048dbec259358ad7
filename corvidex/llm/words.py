"""Words and word-sequence hashes of whole texts, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything at ``limit`` words, so a worker's memory is bounded."""

    limit = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, lower-cased."""
    if "İ" in text:  # its lower case has a combining mark, which would split the word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def word_hashes(tokens: list[str], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, in order of position."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix64(out * np.uint64(0x100000001B3) ^ h[k : k + m])
    return out

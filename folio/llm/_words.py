"""Words of a text as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word, kept for the words seen lately; memory is bounded by KEEP words."""

    KEEP = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.KEEP:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_seen = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in lower case; a word is a longest run of letters, digits or underscores."""
    words = WORD.findall(text.lower()) if text else ()
    return np.fromiter(map(_seen.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on each element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k elements of h; of all of them, if they are fewer than k."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _M + h[j : j + n]
    return mix(out + np.uint64(k))

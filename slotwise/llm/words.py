"""Words of a text and 64-bit hashes of words and shingles, as numpy arrays.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return, which is what ``bytes.split()`` yields; ``bytes.lower()`` lowers A-Z alone.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

import numpy as np
import xxhash

#: Words that a process remembers at most, and their longest in bytes; when full, it starts anew.
CACHE_WORDS = 1_000_000
LONGEST_KEPT = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


_CACHES: weakref.WeakSet[Cache] = weakref.WeakSet()


def forget() -> None:
    """Empty the caches of this process, for a task whose worker goes on to tasks of other stages."""
    for cache in _CACHES:
        cache.clear()


class Cache(dict):
    """word -> value, computed on first use and forgotten when full."""

    __hash__ = object.__hash__

    def __init__(self, value: Callable[[bytes], object]):
        super().__init__()
        self.value = value
        _CACHES.add(self)

    def __missing__(self, word: bytes) -> object:
        value = self.value(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


@functools.cache
def word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def windows(word_hash: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; for fewer words, one hash of them all."""
    size = min(size, len(word_hash))
    n = len(word_hash) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * _FACTOR + word_hash[k : n + k])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the lowered text; empty without words."""
    words = (text or "").encode().lower().split()
    return np.unique(windows(hashes(words), size)) if words else np.zeros(0, dtype=np.uint64)

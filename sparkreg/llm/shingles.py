"""Hashed five-word shingles, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

N = 5
TEXTS = 1000  # rows of an Arrow batch of whole texts
MAX_WORDS = 150_000  # of the cache of word hashes; about 30 MB a worker while a task runs
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def forget() -> None:
    """Empty the cache and give freed memory back; the end of a task does so."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: list[str], short: bool = True, size: int = N) -> np.ndarray:
    """The hash of every window of size words, in order, with repeats. Fewer words are one window if short, else none."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    if n < 1:
        if not short or not len(h):
            return np.empty(0, np.uint64)
        n, take = 1, len(h)
    else:
        take = size
    out = np.zeros(n, np.uint64)
    for k in range(take):
        out = out * _P + h[k : k + n]
    return mix(out + np.uint64(take))

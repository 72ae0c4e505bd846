"""Words of many texts at once, as 64-bit hashes, in numpy.

A word is a run of bytes other than space and tab to carriage return, with A-Z in lower case. Its hash is a sum over its
bytes of random numbers, weighted by powers of an odd number by place, and then mixed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
VALUES = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(size, STEP)])
        return up, np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(int(STEP), -1, 1 << 64)))])


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the number of words at the end)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    word = ~BLANK[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(VALUES[LOWER[data]] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    starts = np.cumsum(np.r_[1, np.array([len(t) + 1 for t in texts], np.int64)])
    return h, np.searchsorted(begin, starts)


def hash_of(word: bytes) -> int:
    return int(hashes([word])[0][0])

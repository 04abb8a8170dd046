"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers; beyond this it starts anew.
MAX_WORDS = 400_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


class WordHasher:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(tokens):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size if n > 0 else 0):
        out = mix(out * MULTIPLIERS[i % 5] + hashes[i : i + n] + np.uint64(i + 1))
    return out


def shingle_set(hasher: WordHasher, text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, one without words none."""
    tokens = words(text)
    return np.unique(grams(hasher(tokens), min(size, len(tokens)))) if tokens else np.zeros(0, dtype=np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class MinHash:
    """Minima of the set under `size` multiply-add orders, as 32-bit values."""

    def __init__(self, size: int):
        rng = np.random.default_rng(90_131)
        self.a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * 2 + 1
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(shingles), 512):
            x = (shingles[at : at + 512] >> np.uint64(32)).astype(np.uint32)[:, None]
            np.minimum(low, (x * self.a + self.b).min(axis=0), out=low)
        return low

"""Word shingles and minimum signatures, as numpy arrays over one document."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_S32, _S29 = np.uint64(32), np.uint64(29)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space, with A-Z lower-cased and all else left alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _S32
    h *= _D
    h ^= h >> _S29
    h *= _A
    h ^= h >> _S32
    return h


def shingle_hashes(tokens: list[bytes], n: int, short: bool = True) -> np.ndarray:
    """64-bit hashes of all n-word windows in order; with fewer words (and `short`) of the whole sequence."""
    k = len(tokens)
    if k == 0 or (k < n and not short):
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, k)
    width = min(n, k)
    h = np.full(k - width + 1, np.uint64(width))
    for i in range(width):
        h *= _B
        h += w[i : k - width + 1 + i]
        h ^= h >> _S32
        h *= _C
    return _mix(h)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(words(text), n))


class Minima:
    """`count` minimum values of a set, each under its own 32-bit permutation."""

    def __init__(self, count: int, seed: int = 1):
        g = np.random.default_rng(seed)
        self.flip = g.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]
        self.times = (g.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1))[:, None]
        self.count = count

    def of(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> _S32).astype(np.uint32)
        low = np.full(self.count, np.uint32(0xFFFFFFFF))
        for a in range(0, len(x), 2048):
            np.minimum(low, ((x[a : a + 2048] ^ self.flip) * self.times).min(axis=1), out=low)
        return low


def fingerprint(sorted_set: np.ndarray) -> bytes:
    return xxh3_128_digest(sorted_set.tobytes())

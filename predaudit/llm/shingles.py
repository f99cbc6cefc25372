"""Words and word shingles of whole texts, as hashes in numpy arrays; helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

SHINGLE = 5

_ODD = np.random.RandomState(20).randint(0, 2**62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, split at space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles; with fewer words one for the whole sequence; none without words."""
    w = word_hashes(words(text))
    k = min(size, len(w))
    if not k:
        return w
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64) * _ODD[15]
    for j in range(k):
        total += w[j : j + n] * _ODD[j]
    return np.unique(mix(total))

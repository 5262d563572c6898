"""Word shingles as 64-bit hashes, for the operators that work in Python."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles, A-Z lower-cased.

    bytes.lower and bytes.split treat just A-Z and the six ASCII spaces. With
    fewer than k words the whole sequence is the one shingle; without words
    the set is empty.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k0 = min(k, n)
    h = np.full(n - k0 + 1, k0, np.uint64)
    for j in range(k0):
        h = mix(h * _MUL + w[j : n - k0 + 1 + j])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]

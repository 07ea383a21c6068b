"""Word shingles of a text as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word; words are runs of bytes other than ASCII white space, with A-Z lower-cased and nothing else."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MIX[0] + h[i : i + n] * _MIX[1 + i % 7]
    out ^= out >> np.uint64(32)
    out *= _MIX[2]
    return out ^ (out >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles of k words; a text of fewer words has one, of all its words; one without words has none."""
    h = word_hashes(text)
    return np.unique(grams(h, min(k, len(h)))) if len(h) else h


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)

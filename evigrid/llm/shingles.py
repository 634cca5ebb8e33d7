"""Word-shingle sets and one-permutation MinHash signatures as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_IN_SHINGLE, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of shingles of so many words (five at most).

    A-Z is folded, words part at ASCII white space; fewer words make one shingle,
    none make an empty set.
    """
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(h) < words:
        return mix(((h + np.uint64(len(h))) * _ODD[: len(h)]).sum(dtype=np.uint64, keepdims=True))
    n = len(h) - words + 1
    total = h[:n] * _ODD[0]
    for i in range(1, words):
        total += h[i : i + n] * _ODD[i]
    return np.unique(mix(total))


def _borrow_table(tries: int = 64) -> np.ndarray:
    """For each bin the bins that it asks in turn when empty: the same random walk for all documents."""
    rng = np.random.default_rng(20170801)
    return np.stack([np.concatenate([[b], rng.integers(0, BINS, tries)]) for b in range(BINS)])


_BORROW = _borrow_table()


def signature(s: np.ndarray) -> np.ndarray:
    """One permutation split into bins, the least hash of each; empty bins are filled by optimal densification.

    Each empty bin asks bins in a fixed random order until one holds a value, so two
    sets agree in a filled bin with the probability of their similarity.
    """
    bins = (s >> np.uint64(57)).astype(np.int64)  # s is sorted: a bin's least value comes first
    held, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    values[held], full[held] = s[first], True
    if not full.all():
        asked = full[_BORROW]
        source = _BORROW[np.arange(BINS), asked.argmax(1)]
        lost = ~asked.any(1)
        source[lost] = held[0]
        values = values[source]
    return values


def bands(s: np.ndarray) -> np.ndarray:
    """A bucket key for each band of ROWS neighbouring bins."""
    v = signature(s).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[4]
    for i in range(ROWS):
        key = mix(key ^ (v[:, i] * _ODD[i]))
    return key.astype(np.int64)

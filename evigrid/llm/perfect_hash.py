"""Minimal perfect hashing of distinct 64-bit keys in numpy: levels of bitmaps, keys kept for verification.

Level by level every key left takes one place of a bitmap; places taken by exactly one key are set,
the others' keys go on to the next level.  A key's number is the count of set places before its own.
"""

from __future__ import annotations

import numpy as np

from evigrid.llm.shingles import mix

#: Places per key left on a level, and levels before the few keys left are held as they are.
ROOM, LEVELS = 2.0, 24
_STEP = 0x9E3779B97F4A7C15


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ np.uint64((seed + 1) * _STEP & (1 << 64) - 1))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The table that a key belongs to."""
    return (spread(keys, 97) % np.uint64(shards)).astype(np.int32)


class PerfectHash:
    """Numbers 0..n-1 of n distinct keys; -1 for any other key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray, keys: np.ndarray | None = None):
        self.sizes, self.bits, self.rest, self.keys = sizes, bits, rest, keys
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(1) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.words = bits.view("<u8")

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct integers."""
        left, sizes, flags = keys, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(ROOM * len(left)) // 64) * 64 or 64
            at = (spread(left, level) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flags.append(once)
            left = left[~once[at]]
        bits = np.packbits(np.concatenate(flags), bitorder="little") if flags else np.zeros(0, np.uint8)
        made = cls(np.array(sizes, np.int64), bits, np.sort(left))
        order = np.empty(len(keys), np.int64)
        order[made.number(keys)] = np.arange(len(keys))
        made.keys = keys[order]
        return made

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, without verification."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            place = start + (spread(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            below = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[open_[hit]] = self.before[w] + np.bitwise_count(below)
            open_ = open_[~hit]
            if not len(open_):
                break
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where the stored key is another one."""
        at = self.number(keys)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)

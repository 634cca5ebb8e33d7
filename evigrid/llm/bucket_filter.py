"""Which buckets of a hash space are hit often: upper bounds of counts, as a bitmap.

Each buffer of texts gives its buckets with their counts, cut off at the asked least count (sums of
cut counts reach it exactly when the true sums do).  Ranges of buckets are summed apart in dense
vectors, and what comes back is one bit a bucket.  A bucket's count is at least that of each key
in it, so a key of a bucket without its bit is rare: no frequent key is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "level int, range int, buckets binary, held binary"


def bits_for(keys: float, lo: int = 14, hi: int = 28) -> int:
    """Bits of a space with twice as many buckets as keys, within bounds (a full space prunes less, and loses nothing)."""
    return int(min(max(np.ceil(np.log2(max(keys, 1))) + 1, lo), hi))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


#: Ranges that a space is summed in (a power of two).
RANGES = 64


class Gathered:
    """The buckets that a task has hit so far, a level at a time; ``put`` gives rows once they are many, ``rest`` the last ones."""

    def __init__(self, bits: dict[int, int], least: int, most: int = 3_000_000):
        self.bits, self.least, self.most, self.held, self.n = bits, least, most, {}, 0

    def put(self, level: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.setdefault(level, []).append(bucket_of(hashes, self.bits[level]))
        self.n += len(hashes)
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for level, parts in self.held.items():
            yield from _rows(level, np.concatenate(parts), self.bits[level], self.least)
        self.held, self.n = {}, 0


def _rows(level: int, hit: np.ndarray, bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each range that has any of these buckets: steps from one to the next (65535 goes on), and counts."""
    buckets, n = np.unique(hit, return_counts=True)
    if not len(buckets):
        return
    held, wide = np.minimum(n, least).astype(np.uint8), (1 << bits) // RANGES
    cut = np.searchsorted(buckets, np.arange(RANGES + 1, dtype=np.int64) * wide)
    some, steps, counts = np.flatnonzero(cut[1:] > cut[:-1]), [], []
    for r in some:
        step = np.diff(buckets[cut[r] : cut[r + 1]].astype(np.int64), prepend=r * wide)
        far = step // 65535
        full = np.full(len(step) + int(far.sum()), 65535, np.uint16)
        count = np.zeros(len(full), np.uint8)
        last = np.cumsum(far + 1) - 1
        full[last], count[last] = step % 65535, held[cut[r] : cut[r + 1]]
        steps.append(full.tobytes())
        counts.append(count.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), level, np.int32)), pa.array(some.astype(np.int32)), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], names=["level", "range", "buckets", "held"])


def frequent(rows: DataFrame, bits: dict[int, int], least: int) -> dict[int, np.ndarray]:
    """level -> packed bits of its buckets with at least ``least`` (under 128) hits.

    A task holds one byte a bucket of its ranges; the driver gets 2**bits / 8 bytes a level.
    """

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for level, r, buckets, n in zip(*(c.to_pylist() for c in b.columns)):
                wide = (1 << bits[level]) // RANGES
                v = held.setdefault((level, r), np.zeros(wide, np.uint8))
                at, n = np.cumsum(np.frombuffer(buckets, np.uint16), dtype=np.int64), np.frombuffer(n, np.uint8)
                at, n = at[n > 0], n[n > 0]
                v[at] = np.minimum(v[at] + n, least)
        for (level, r), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([r], pa.int32()), pa.array([np.packbits(v >= least, bitorder="little").tobytes()])], names=["level", "range", "bits"])

    out = {level: np.zeros(1 << (b - 3), np.uint8) for level, b in bits.items()}
    for r in rows.repartition("level", "range").mapInArrow(run, "level int, range int, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["level"]][r["range"] * len(part) : (r["range"] + 1) * len(part)] = part
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bucket of each hash has its bit."""
    at = bucket_of(hashes, bits)
    return (bitmap[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(bool)

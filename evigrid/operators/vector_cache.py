"""Vectors of texts under a key of model, size and content: read from a stored cache, computed once where missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid import params as P
from evigrid.operators.store import SegmentStore
from evigrid.session import ship, stored


def hashed_terms(texts: list[str]) -> np.ndarray:
    """A stand-in embedder: terms hashed into dimensions, unit length.  A real one takes texts and gives rows of floats alike."""
    import hashlib

    import regex

    out = np.zeros((len(texts), P.EMBEDDING_DIMS), np.float32)
    for row, text in zip(out, texts):
        for term in regex.findall(P.TERM, text.lower()):
            row[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % P.EMBEDDING_DIMS] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class VectorCache:
    """(cache_key, vector) rows in a segment store; a run's new vectors are one commit."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[list[str]], np.ndarray], model: str = P.EMBEDDING_MODEL, dims: int = P.EMBEDDING_DIMS, batch: int = 96):
        self.store, self.embed, self.prefix, self.batch = SegmentStore(ship(spark), path, "cache_key"), embed, f"{model}:{dims}:", batch

    def vectors(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, cache_key, hit, vector) of every text; a null text has none.  Missing ones are embedded by distinct text and kept."""
        asked = stored(texts.where(F.col(text).isNotNull()).select(key, F.concat(F.lit(self.prefix), F.sha2(F.col(text), 256)).alias("cache_key"), F.col(text).alias("text")))
        known = self.store.live()
        rows = asked.select("cache_key", "text") if known is None else asked.join(known.select("cache_key"), "cache_key", "left_anti").select("cache_key", "text")
        missing = stored(rows.groupBy("cache_key").agg(F.first("text").alias("text")))
        if known is None or not missing.isEmpty():
            self.store.replace(missing.mapInArrow(self._run(), "cache_key string, vector array<float>"))
        new = missing.select("cache_key", F.lit(False).alias("hit"))
        full = self.store.read().join(new, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(True)))
        return asked.drop("text").join(full, "cache_key").select(key, "cache_key", "hit", "vector")

    def _run(self):
        embed, size = self.embed, self.batch

        def run(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, size):
                    part = b.slice(lo, size)
                    made = np.asarray(embed(part.column(1).to_pylist()), np.float32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(made), pa.list_(pa.float32()))], names=["cache_key", "vector"])

        return run

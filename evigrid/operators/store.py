"""Tables that are changed by key: segments written aside, and a manifest that names the live ones.

A change writes its rows and the keys it replaces to a new folder, then one manifest row with the list
of segments.  Readers open the newest manifest, so they see a change whole or not at all; a change of an
epoch that the manifest knows is skipped, so a stream may replay it.  A row is live while no later segment
replaces its key.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "version long, segments array<struct<id:long,folder:string>>, epochs array<long>"
#: As many changed keys go to all tasks, so that wide rows stay where they are; with more of them both sides are dealt by key.
KEYS_SENT = 1_000_000


def sent(keys: DataFrame) -> DataFrame:
    """Stored keys, sent to all tasks where they are few."""
    return F.broadcast(keys) if keys.count() <= KEYS_SENT else keys


class SegmentStore:
    """A table under ``path`` whose rows are replaced by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def _state(self) -> tuple[int, list, list]:
        """Version, segments and epochs of the newest manifest."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
            last = rows.orderBy(F.desc("version")).first()
        except Exception as e:  # the store is new
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return (last["version"], [(s["id"], s["folder"]) for s in last["segments"]], list(last["epochs"])) if last else (-1, [], [])

    def _commit(self, version: int, segments: list, epochs: list) -> None:
        self.spark.createDataFrame([(version, segments, epochs)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, epoch: int | None = None, more: Callable[[str], Iterable[tuple[str, DataFrame]]] | None = None) -> bool:
        """Rows of ``keys`` (the keys of the new rows without them) give way to ``rows``; False if the epoch is known.

        ``more`` gives further tables of the segment in turn, as (name, table), from the folder that its rows, keys and
        earlier tables are written to.
        """
        version, segments, epochs = self._state()
        if epoch is not None and epoch in epochs:
            return False
        folder = f"{self.path}/segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{folder}/rows")
        (keys if keys is not None else written).select(self.key).distinct().write.parquet(f"{folder}/keys")
        for name, table in more(folder) if more else ():
            table.write.parquet(f"{folder}/{name}")
        self._commit(version + 1, [*segments, (self.next_id(segments), folder)], epochs if epoch is None else [*epochs, epoch])
        return True

    @staticmethod
    def next_id(segments: list) -> int:
        return segments[-1][0] + 1 if segments else 0

    def parts(self, name: str, segments: list | None = None) -> DataFrame | None:
        """All segments' tables of that name, each row with its ``segment``; null without any."""
        out = None
        for i, folder in self._state()[1] if segments is None else segments:
            part = self.spark.read.parquet(f"{folder}/{name}").withColumn("segment", F.lit(i).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def live(self, name: str = "rows") -> DataFrame | None:
        """Live rows of the segments' tables of that name, which hold the key, with their segment.

        The first segment's keys are not read, and rows of the newest one meet nothing.
        """
        segments = self._state()[1]
        if len(segments) < 2:
            return self.parts(name, segments)
        last = self.parts("keys", segments[1:]).groupBy(self.key).agg(F.max("segment").alias("segment"))
        later = F.col(f"l.{self.key}").eqNullSafe(F.col(f"r.{self.key}")) & (F.col("l.segment") > F.col("r.segment"))
        return self.parts(name, segments[:-1]).alias("r").join(sent(last).alias("l"), later, "left_anti").unionByName(self.parts(name, segments[-1:]))

    def read(self) -> DataFrame:
        """Live rows."""
        return self.live().drop("segment")

    def compact(self) -> None:
        """All live rows in one segment; old folders stay for readers that have them open."""
        version, _, epochs = self._state()
        folder = f"{self.path}/segment-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{folder}/rows")
        self.spark.read.parquet(f"{folder}/rows").select(self.key).distinct().write.parquet(f"{folder}/keys")
        self._commit(version + 1, [(0, folder)], epochs)


def upsert_sink(store: SegmentStore):
    """For ``foreachBatch``: rows of a batch replace those of their keys, of a key's rows in one batch the last by ``seq``; an epoch counts once."""

    def put(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy(store.key).agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        store.replace(last, epoch=epoch)

    return put

"""A stored index of chunks that follows its documents: only changed documents are read and written again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid import params as P
from evigrid.operators.bags import postings_of
from evigrid.operators.retrieval import Index
from evigrid.operators.store import SegmentStore, sent


class ChunkStore(SegmentStore):
    """Chunks (point_id, document_id, project_id, content, is_quarantined and others) with what searches read.

    A segment holds its chunks, their bags of terms, and signed changes of document frequencies, counts and
    lengths: those of the chunks that it adds less those of the chunks that it replaces.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "document_id")

    def put(self, points: DataFrame, documents: DataFrame | None = None) -> None:
        """Index ``points``; of ``documents`` (their own without it) all earlier chunks go.

        A document of ``documents`` without chunks in ``points`` is gone from the index.  Chunks are written once
        and read back for their bags, and frequencies are counted from the bags, of which nothing else is dealt out.
        """
        read = self.spark.read.parquet

        def more(folder: str) -> Iterator[tuple[str, DataFrame]]:
            yield "bags", Index.bags_of(read(f"{folder}/rows"))
            signed = read(f"{folder}/bags").select("dl", "terms", F.lit(1).alias("sign"))
            old = self.live("bags")  # this segment is not in the manifest yet
            if old is not None:
                keys = read(f"{folder}/keys")
                gone = old.alias("r").join(sent(keys).alias("l"), F.col("l.document_id").eqNullSafe(F.col("r.document_id")), "left_semi")
                signed = signed.unionByName(gone.select("dl", "terms", F.lit(-1).alias("sign")))
            each = signed.select(F.explode("terms").alias("term"), "sign")  # a bag names a term once
            yield "terms", each.groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
            total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
            yield "stats", signed.agg(total("sign").alias("n"), total(F.col("dl") * F.col("sign")).alias("length"))

        self.replace(points, documents, more=more)

    def index(self, embed=None, dims: int = P.EMBEDDING_DIMS) -> Index:
        """The live chunks as an index: frequencies and counts are summed, bags read as they are."""
        segments = self._state()[1]
        points, held = self.live().drop("segment"), self.live("bags").drop("segment")
        stats = self.parts("stats", segments).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        df = self.parts("terms", segments).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        out = Index.__new__(Index)
        out._open(points, postings_of(held), stats["n"], embed, dims, df, held)
        out._mean = float(stats["length"] / max(stats["n"], 1) or 1.0)
        return out

"""Approximate neighbours by random-projection buckets with several probes, scored exactly inside them.

Each bucket is the side of ``planes`` random planes that a vector lies on.  A question asks the buckets in
order of how far it would have to move to lie in them.  How many it asks is measured: the least number with
which a bounded sample of the collection finds ``target`` of its exact neighbours, so vectors without any
structure are asked nearly whole, and clustered ones in few buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evigrid.operators.vectors import _leading, _unit, exact_topk
from evigrid.session import ship, stored

#: Rows of a part of a bucket, and sampled questions that the number of probes is measured on.
PART, SAMPLE = 4096, 64


def _margins(b: pa.Array, normals: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from the planes."""
    return _unit(np.stack(b.to_numpy(zero_copy_only=False)).astype(float)) @ normals.T


class ProjectionIndex:
    """Stored buckets of (point_id, embedding)."""

    def __init__(self, points: DataFrame, planes: int = 6, target: float = 0.95, seed: int = 11):
        ship(points.sparkSession)
        self.planes, self.target, self.points = planes, target, points
        first = points.where("embedding is not null").first()
        dims = len(first["embedding"]) if first else 1
        self.normals = np.random.default_rng(seed).normal(size=(planes, dims))
        placed = self._placed(points, "point_id")
        parts = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
        self.rows = stored(placed.join(F.broadcast(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("point_id"), "parts").cast("int")).drop("parts"))  # at most 2 ** planes buckets
        self.parts = stored(self.rows.select("bucket", "part").distinct())
        self.probes: int | None = None

    def _placed(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, embedding, bucket)."""
        normals = self.normals

        def run(batches):
            for b in batches:
                if b.num_rows:
                    side = _margins(b.column(1), normals) > 0
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array((side << np.arange(len(normals))).sum(1).astype(np.int32))], names=[key, "embedding", "bucket"])

        return rows.where("embedding is not null").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, f"{key} long, embedding array<float>, bucket int")

    def _probed(self, questions: DataFrame, probes: int) -> DataFrame:
        """(qid, embedding, bucket, order) of the first buckets of each question."""
        normals, sides = self.normals, (np.arange(1 << self.planes)[:, None] >> np.arange(self.planes)) & 1 > 0

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = _margins(b.column(1), normals)
                    cost = np.stack([np.where(side != (m > 0), m * m, 0).sum(1) for side in sides], 1)
                    first = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                    row = np.repeat(np.arange(b.num_rows), first.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(first.ravel().astype(np.int32)), pa.array(np.tile(np.arange(first.shape[1]), b.num_rows).astype(np.int32))], names=["qid", "embedding", "bucket", "probe"])

        return questions.where("embedding is not null").select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "qid long, embedding array<float>, bucket int, probe int")

    def topk(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, point_id, score, rank), the question itself left out; each bucket part meets its questions in one task."""
        probes = probes or self._measured(k)
        asked = self._probed(questions, probes).join(F.broadcast(self.parts), "bucket")

        def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return pd.DataFrame({"qid": [], "point_id": [], "score": []})
            score = np.round(_unit(np.stack(q["embedding"]).astype(float)) @ _unit(np.stack(p["embedding"]).astype(float)).T, 6)
            score[q["qid"].to_numpy()[:, None] == p["point_id"].to_numpy()] = -np.inf
            n = min(k, score.shape[1])
            least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n, None]
            i, j = np.nonzero((score >= least) & (score > -np.inf))
            ids, s = p["point_id"].to_numpy()[j], score[i, j]
            keep = _leading(i, ids, s, k)
            return pd.DataFrame({"qid": q["qid"].to_numpy()[i[keep]], "point_id": ids[keep], "score": s[keep]})

        found = asked.groupBy("bucket", "part").cogroup(self.rows.groupBy("bucket", "part")).applyInPandas(meet, "qid long, point_id long, score double")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "point_id")
        return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)

    def _measured(self, k: int) -> int:
        """The least number of probes with which the sample finds its share of exact neighbours."""
        if self.probes is None:
            sample = stored(self.points.where("embedding is not null").orderBy(F.xxhash64("point_id"), "point_id").limit(SAMPLE).withColumnRenamed("point_id", "qid"))
            exact = exact_topk(sample, self.points.where("embedding is not null"), k).select("qid", "point_id")
            where = self._probed(sample, 1 << self.planes).select("qid", "bucket", "probe")
            placed = exact.join(self.rows.select("point_id", "bucket"), "point_id").join(where, ["qid", "bucket"])
            seen = {r["probe"]: r["n"] for r in placed.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).collect()}
            total, held = sum(seen.values()), 0
            self.probes = 1 << self.planes
            for i in range(1 << self.planes):
                held += seen.get(i, 0)
                if held >= self.target * total:
                    self.probes = i + 1
                    break
        return self.probes


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of a question's exact neighbours that were found."""
    hit = exact.select("qid", "point_id").join(found.select("qid", "point_id", F.lit(1).alias("hit")), ["qid", "point_id"], "left")
    return hit.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))

"""Exact best points of many questions by upper bounds: rare terms first, then only what may still matter.

A posting block holds the postings of one term in one slot of points (hash slots of about ``BLOCK`` points,
so a frequent term is many blocks in many tasks), with the most and the least that bound its weights.

1. The rarest terms of each question, as far as they hold about ``FIRST`` times n postings, are read whole;
   the n-th best sum of a question's searchable points is its threshold.
2. A point without any of these terms can reach the threshold only where the bounds of its other terms add
   up to it: blocks for which they do not are never read.
3. Points that may still reach the threshold get their missing terms from the blocks of their own slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evigrid.session import stored

BLOCK, FIRST = 1024, 128
#: Scores are rounded to six digits before they are ranked, so bounds keep that distance.
NEAR = 1e-6


def posting_blocks(postings: DataFrame, n: int, key: str = "point_id") -> DataFrame:
    """(term, slot, most_tf, least_dl, rows of (point, tf, dl)) of the postings of n points."""
    slots = max(1, -(-n // BLOCK))
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("long")
    rows = postings.select("term", slot.alias("slot"), F.struct(F.col(key).alias("point"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")).alias("p"))
    return rows.groupBy("term", "slot").agg(F.max("p.tf").alias("most_tf"), F.min("p.dl").alias("least_dl"), F.collect_list("p").alias("rows")).sortWithinPartitions("term")


def _in_scope(rows: DataFrame, index, scope: DataFrame) -> DataFrame:
    """Pairs (qid, point_id, slot, ...) of searchable points within the question's project and documents."""
    listed = "documents" in scope.columns
    live = rows.join(index.live, "point_id")
    ok = live.join(F.broadcast(scope) if index.sent else scope, "qid").where("scope is null or scope = project_id")
    if listed:
        ok = ok.where("documents is null or size(documents) = 0 or array_contains(documents, document_id)")
    return ok.select(*rows.columns)


def _partial(asked: DataFrame, blocks: DataFrame, index) -> DataFrame:
    """(qid, point_id, slot, part): sums over the asked terms of their blocks."""
    hits = blocks.join(asked.select("qid", "term", "idf"), "term").select("qid", "slot", "idf", F.explode("rows").alias("p"))
    weight = index.saturated(F.col("p.tf"), F.col("p.dl")) * F.col("idf")
    return hits.groupBy("qid", F.col("p.point").alias("point_id"), "slot").agg(F.sum(weight).alias("part"))


def scored(asked: DataFrame, index, scope: DataFrame, n: int) -> DataFrame:
    """(qid, point_id, score) of all points that are among the n best of a question, and some others.

    asked: (qid, term, df, idf), terms distinct.
    """
    blocks = index.blocks()
    bound = blocks.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.max(index.saturated(F.col("most_tf"), F.col("least_dl"))).alias("top"))
    order = Window.partitionBy("qid").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rated = asked.join(bound, "term").withColumn("reach", F.col("idf") * F.col("top")).withColumn("first", before < FIRST * n)
    rated = stored(rated)
    rest = rated.where("not first")
    left = rest.groupBy("qid").agg(F.sum("reach").alias("rest"))  # what all terms not read can add
    seen = stored(_in_scope(_partial(rated.where("first"), blocks, index), index, scope))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part")))
    limit = stored(seen.withColumn("place", place).where(F.col("place") == n).select("qid", F.col("part").alias("limit")))
    # points with none of the first terms: a block is read where it may lift one of them to the limit
    open_ = rest.join(left, "qid").join(limit, "qid", "left").where(F.col("limit").isNull() | (F.col("rest") >= F.col("limit") - NEAR))
    new = None
    if not open_.isEmpty():
        reads = blocks.join(open_.select("qid", "term", "idf", "reach", "rest", "limit"), "term")
        reads = reads.where(F.col("limit").isNull() | (F.col("rest") - F.col("reach") + F.col("idf") * index.saturated(F.col("most_tf"), F.col("least_dl")) >= F.col("limit") - NEAR))
        found = reads.select("qid", "slot", F.explode("rows.point").alias("point_id")).distinct().join(seen.select("qid", "point_id"), ["qid", "point_id"], "left_anti")
        new = _in_scope(found.select("qid", "point_id", "slot"), index, scope).withColumn("part", F.lit(0.0))
    all_ = seen if new is None else seen.unionByName(new)
    may = all_.join(left, "qid", "left").join(limit, "qid", "left").where(F.col("limit").isNull() | (F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("limit") - NEAR)).select("qid", "point_id", "slot", "part")
    may = stored(may)
    # their other terms, from the blocks of their own slots alone
    wanted = may.select("qid", "point_id", "slot").join(rest.select("qid", "term", "idf"), "qid")
    read = blocks.join(wanted.select("term", "slot").distinct(), ["term", "slot"], "left_semi").select("term", "slot", F.explode("rows").alias("p")).select("term", "slot", F.col("p.point").alias("point_id"), index.saturated(F.col("p.tf"), F.col("p.dl")).alias("w"))
    more = wanted.join(read, ["term", "slot", "point_id"]).groupBy("qid", "point_id").agg(F.sum(F.col("w") * F.col("idf")).alias("more"))
    return may.join(more, ["qid", "point_id"], "left").select("qid", "point_id", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))

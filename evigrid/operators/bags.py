"""Bags of terms: one row a text with its distinct terms and their counts, made and read in single passes without an exchange."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evigrid.functions.text import terms
from evigrid.session import ship, stored

BAG = "dl int, terms array<string>, tfs array<int>"


def bags(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """Columns of ``keep``, dl (number of terms), terms (distinct) and tfs, one row a text."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            dl = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
            coded = lists.flatten().dictionary_encode()
            width = max(len(coded.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(b.num_rows), dl.to_numpy()) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            at = pa.array(np.searchsorted(pair, np.arange(b.num_rows + 1) * width), pa.int32())
            named = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(pair % width)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], dl, named, pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], names=[*keep, "dl", "terms", "tfs"])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep]
    return texts.select(*keep, terms(F.col(text)).alias("_w")).mapInArrow(count, ", ".join([*kinds, BAG]))


def postings_of(held: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, term, tf, dl) of bags."""
    return held.select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(key, F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"), "dl")


def found(lists: pa.ListArray, of: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and number in ``of`` (-1 without one) of each term of a column of lists."""
    size = lists.value_lengths().to_numpy()
    coded = lists.flatten().dictionary_encode()
    number = np.fromiter(map(of.get, coded.dictionary.to_pylist(), repeat(-1)), np.int64, len(coded.dictionary))
    return np.repeat(np.arange(len(lists)), size), number[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)


def lists_of(rows: int, place: np.ndarray, *values: pa.Array) -> list[pa.ListArray]:
    """Columns of lists from values whose rows (ascending) are ``place``."""
    at = pa.array(np.searchsorted(place, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(at, v) for v in values]


def cells(row: np.ndarray, bucket: np.ndarray, x: np.ndarray, rows: int, dims: int, step: int = 1 << 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and sum of each cell that is hit, in order; rows ascend, and a cell's values are added in theirs."""
    parts = []
    for lo in range(0, rows, step):
        a, b = np.searchsorted(row, [lo, lo + step])
        at = (row[a:b] - lo) * dims + bucket[a:b]
        n = min(step, rows - lo) * dims
        hit = np.zeros(n, bool)
        hit[at] = True
        cell = np.flatnonzero(hit)
        parts.append((cell // dims + lo, cell % dims, np.bincount(at, x[a:b], n)[cell]))
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def least_sent(idf: DataFrame, sent: int) -> int:
    """The least frequency that keeps the terms of that one and more within ``sent``; 0 where all terms are.

    Frequencies past 2^16 count as one.
    """
    sizes = {r["k"]: r["n"] for r in idf.groupBy(F.least("df", F.lit(1 << 16)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 1 << 62, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > sent:
            return least
        least = k
    return 0


def unit_rows(held: DataFrame, idf: DataFrame, dims: int, sent: int) -> DataFrame:
    """Bags to vectors of unit length: their other columns, buckets b and weights w; bags without a term have none.

    ``idf``: (term, df, idf, bucket).  At most ``sent`` of the most frequent terms go to all tasks; the rarer
    ones, which hold few postings, are joined by term and meet the sums of the others by point.
    """
    keep = [c for c in held.columns if c not in ("dl", "terms", "tfs")]
    kinds = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in keep)
    spark = ship(held.sparkSession)
    least = least_sent(idf, sent)
    known = idf.where(F.col("df") >= least).select("term", "idf", "bucket").toArrow()
    table = spark.sparkContext.broadcast((known.column("term").to_pylist(), known.column("idf").to_numpy(), known.column("bucket").to_numpy()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, bucket = table.value
        of = {t: i for i, t in enumerate(names)}
        for b in batches:
            n, flat, tf = b.num_rows, b.column(len(keep)).flatten(), b.column(len(keep) + 1).flatten().to_numpy()
            row, no = found(b.column(len(keep)), of)
            ok = no >= 0
            place, at, x = cells(row[ok], bucket[no[ok]], tf[ok] * weight[no[ok]], n, dims)
            b_, w_ = lists_of(n, place, pa.array(at), pa.array(x))
            terms_, tfs_ = lists_of(n, row[~ok], flat.filter(pa.array(~ok)), pa.array(tf[~ok], pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], b_, w_, terms_, tfs_], names=[*keep, "b", "w", "terms", "tfs"])

    part = held.select(*keep, "terms", "tfs").mapInArrow(sums, f"{kinds}, b array<long>, w array<double>, terms array<string>, tfs array<int>")
    if least > 0:
        part = stored(part)
        rare = part.select("point_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("point_id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
        rare = rare.join(idf.where(F.col("df") < least).select("term", "idf", "bucket"), "term").groupBy("point_id").agg(F.collect_list(F.struct("bucket", (F.col("tf") * F.col("idf")).alias("x"))).alias("r"))
        none = F.array()
        part = part.join(rare, "point_id", "left").select(*keep, F.concat("b", F.coalesce("r.bucket", none)).alias("b"), F.concat("w", F.coalesce("r.x", none)).alias("w"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            row, at, x = cells(row, lists.flatten().to_numpy(), b.column(len(keep) + 1).flatten().to_numpy(), b.num_rows, dims)
            norm = np.sqrt(np.bincount(row, x * x, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *lists_of(b.num_rows, row, pa.array(at), pa.array(x / norm[row]))], names=[*keep, "b", "w"])

    return part.select(*keep, "b", "w").where("size(b) > 0").mapInArrow(unit, f"{kinds}, b array<long>, w array<double>")

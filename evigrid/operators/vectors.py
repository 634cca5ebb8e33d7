"""Best products of stored vectors with a stated question set, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evigrid import params as P
from evigrid.operators.bags import found
from evigrid.session import ship

#: Questions of one turn: their matrix and n candidates for each are what a task holds besides its batch.
BLOCK = 4096
#: Questions of one turn where each brings its own terms as columns, and cells of a matrix of points and terms.
TERM_BLOCK, CELLS = 512, 1 << 22
FOUND = "qid long, point_id long, score double"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _leading(q: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each question, ties to the lower id."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < n]


def _best(points: DataFrame, matrix: Callable, qids: np.ndarray, q: np.ndarray, scopes: list, n: int, positive: bool, lists: list | None = None) -> DataFrame:
    """Candidates (qid, point_id, score) of one block: each task keeps the n best of each question over all its batches.

    points: point_id, project_id and the columns that ``matrix`` makes vectors of, document_id last where ``lists``
    binds questions to sorted arrays of documents.  The block is sent once to each worker.
    """
    bound = [(s, np.array([i for i, x in enumerate(scopes) if x == s])) for s in sorted({x for x in scopes if x is not None})]
    sent = points.sparkSession.sparkContext.broadcast((qids, q, bound, [(i, x) for i, x in enumerate(lists or []) if x is not None]))

    def run(batches):
        qids, q, bound, listed = sent.value
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        step = max(1, CELLS // max(q.shape[1], len(qids), 1))
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            ids, project = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).to_pylist(), object)
            raw = matrix(b) @ q.T
            score = np.round(raw, 6)
            off = raw <= 0 if positive else np.zeros(raw.shape, bool)
            for s, at in bound:
                off[np.ix_(project != s, at)] = True
            if listed:
                document = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                for at, own in listed:  # one bitmap of the batch's documents a question
                    off[:, at] |= ~np.isin(document, own)
            score[off] = -np.inf
            least = np.partition(score, len(ids) - n, axis=0)[len(ids) - n] if len(ids) > n else np.full(len(qids), -np.inf)
            row, col = np.nonzero((score >= least) & ~off)
            new = (np.concatenate([held[0], col]), np.concatenate([held[1], ids[row]]), np.concatenate([held[2], score[row, col]]))
            keep = _leading(*new, n)
            held = tuple(x[keep] for x in new)
        yield pa.RecordBatch.from_arrays([pa.array(qids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["qid", "point_id", "score"])

    return points.mapInArrow(run, FOUND)


def _in_blocks(questions: DataFrame, best: Callable[[list], DataFrame], size: int | None = None) -> DataFrame:
    """The union over blocks of the stated questions; one block passes through the driver at a time."""
    block, parts = [], []
    for r in questions.toLocalIterator():
        block.append(r)
        if len(block) == (size or BLOCK):
            parts.append(best(block))
            block = []
    if block or not parts:
        parts.append(best(block))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_topk(questions: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(qid, point_id, score, rank) by cosine of (point_id, embedding), the question itself left out."""
    ship(points.sparkSession)
    matrix = lambda b: _unit(np.stack(b.column(2).to_numpy(zero_copy_only=False)).astype(float))

    def best(rows: list) -> DataFrame:
        q = _unit(np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1))
        named = points.select("point_id", F.lit(None).cast("string").alias("project_id"), "embedding")
        return _best(named if rows else named.limit(0), matrix, np.array([r["qid"] for r in rows], np.int64), q, [None] * len(rows), k + 1, False)

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "point_id")
    found = _in_blocks(questions, best).where("qid <> point_id")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)


def sparse_vector_topk(questions: DataFrame, points: DataFrame, dims: int, n: int) -> DataFrame:
    """Candidates by product of (bucket, w) vectors held as arrays b and w.

    questions: qid, scope (one project or null), b, w and maybe documents (a list of ids, null or empty for
    all); points: point_id, project_id, b, w, and then document_id.  Only pairs that share a bucket count.
    """
    ship(points.sparkSession)

    def dense(rows: int, place: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = np.zeros((rows, dims))
        m[place, b] = w
        return m

    def matrix(batch) -> np.ndarray:
        size = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        return dense(batch.num_rows, np.repeat(np.arange(batch.num_rows), size), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy())

    def best(rows: list) -> DataFrame:
        place = np.repeat(np.arange(len(rows)), [len(r["b"]) for r in rows]).astype(int)
        q = dense(len(rows), place, np.array([x for r in rows for x in r["b"]], int), np.array([x for r in rows for x in r["w"]], float))
        lists = [np.unique(r["documents"]) if r["documents"] else None for r in rows] if listed else None
        named = points.select("point_id", "project_id", "b", "w", *(["document_id"] if listed else []))
        return _best(named, matrix, np.array([r["qid"] for r in rows], np.int64), q, [r["scope"] for r in rows], n, True, lists)

    listed = "documents" in questions.columns
    return _in_blocks(questions.select("qid", "scope", "b", "w", *(["documents"] if listed else [])), best)


def weighted_topk(questions: DataFrame, points: DataFrame, mean: float, n: int) -> DataFrame:
    """Candidates by Okapi weights of bags of terms: a product of the points' weights with the questions' idf.

    questions: qid, scope, t (distinct terms), w (their idf) and maybe documents; points: bags with point_id,
    project_id and document_id where questions are bound to documents.  Only pairs that share a term count.
    """
    ship(points.sparkSession)
    k, c = P.BM25_K1, P.BM25_B

    def best(rows: list) -> DataFrame:
        of: dict = {}
        place = [(i, of.setdefault(t, len(of)), w) for i, r in enumerate(rows) for t, w in zip(r["t"], r["w"])]
        q = np.zeros((len(rows), len(of)))
        for i, j, w in place:
            q[i, j] = w

        def matrix(batch) -> np.ndarray:
            row, no = found(batch.column(3), of)
            tf, dl, ok = batch.column(4).flatten().to_numpy(), batch.column(2).to_numpy(), no >= 0
            row, no, tf = row[ok], no[ok], tf[ok]
            m = np.zeros((batch.num_rows, len(of)))
            m[row, no] = tf * (k + 1) / (tf + k * (1 - c + c * dl[row] / mean))
            return m

        lists = [np.unique(r["documents"]) if r["documents"] else None for r in rows] if listed else None
        named = points.select("point_id", "project_id", "dl", "terms", "tfs", *(["document_id"] if listed else []))
        return _best(named, matrix, np.array([r["qid"] for r in rows], np.int64), q, [r["scope"] for r in rows], n, True, lists)

    listed = "documents" in questions.columns
    return _in_blocks(questions.select("qid", "scope", "t", "w", *(["documents"] if listed else [])), best, TERM_BLOCK)

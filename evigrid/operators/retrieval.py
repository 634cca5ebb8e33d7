"""Index building and hybrid retrieval of many questions at once.

All steps are equi-joins on term, bucket or id.  Candidates are ranked on narrow
tables; texts are joined last.  Ranks count from 0; scores are rounded to six
digits before they are ranked, and ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from evigrid import params as P
from evigrid.functions.text import terms
from evigrid.operators.bags import bags, least_sent, postings_of, unit_rows
from evigrid.operators.pruning import posting_blocks
from evigrid.operators.vectors import sparse_vector_topk, weighted_topk
from evigrid.session import stored


def postings(points: DataFrame, key: str = "point_id", text: str = "content") -> DataFrame:
    """(key, term, tf, dl): one pass, counts combined before the exchange; dl is the number of terms of the text."""
    words = points.select(key, terms(F.col(text)).alias("_w")).select(key, F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def _bucket() -> Column:
    return (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % P.EMBEDDING_DIMS).alias("bucket")


#: Term statistics under this many rows are sent to all tasks; larger ones are joined by term.
TERMS_SENT = 400_000


def _unit_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """(key, bucket, w) of unit length; one exchange by key serves the sums and the norms."""
    rows = weighted.select(key, "bucket", (F.col("tf") * F.col("idf")).alias("x")).repartition(key).groupBy(key, "bucket").agg(F.sum("x").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.withColumn("w", F.col("w") / norm)


class Index:
    """Stored tables of one collection that every search reads: bags of terms, term statistics, vectors; posting blocks where asked for.

    ``embed`` takes (texts, key, text) and gives (key, bucket, w) of unit length with bucket
    under ``dims``; without it vectors are hashed terms weighted by the collection's idf.
    ``points`` may hold ``document_id``; questions may then be bound to lists of documents.
    """

    def __init__(self, points: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame] | None = None, dims: int = P.EMBEDDING_DIMS):
        held = stored(self.bags_of(points))
        df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a bag names a term once
        self._open(points, postings_of(held), held.count(), embed, dims, df, held)

    @staticmethod
    def bags_of(points: DataFrame) -> DataFrame:
        return bags(points, "content", *(c for c in ("point_id", "project_id", "is_quarantined", "document_id") if c in points.columns))

    def _open(self, points: DataFrame, found: DataFrame, n: int, embed, dims: int, df: DataFrame, held: DataFrame) -> None:
        self.points, self.dims, self.embed, self.postings, self.n, self._bags = points, dims, embed or self._hashed, found, n, held
        k = F.col("df")
        self.idf = stored(df.select("term", "df", F.log(1 + (F.lit(float(n)) - k + 0.5) / (k + 0.5)).alias("idf"), _bucket()))
        self.sent = self.idf.count() <= TERMS_SENT
        self.live = points.where("not is_quarantined").select("point_id", "project_id", *(["document_id"] if "document_id" in points.columns else []))
        self._vectors, self._blocks, self._mean = None, None, None

    def terms(self, *columns: str) -> DataFrame:
        """Term statistics, sent to all tasks where they are few."""
        rows = self.idf.select("term", *columns)
        return F.broadcast(rows) if self.sent else rows

    def with_terms(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows (term, ...) with their term's statistics.

        The most frequent terms go to all tasks; only rows of the rarer ones, which are few, are dealt out by term.
        """
        least = least_sent(self.idf, TERMS_SENT)
        known = F.broadcast(self.idf.where(F.col("df") >= least).select("term", *columns))
        out = rows.join(known, "term")
        if least > 0:
            rare = rows.join(known.select("term"), "term", "left_anti")
            out = out.unionByName(rare.join(self.idf.where(F.col("df") < least).select("term", *columns), "term"))
        return out

    def _hashed(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        found = self.postings if key == "point_id" else postings(texts, key, text)
        return _unit_vectors(found.join(self.terms("idf", "bucket"), "term"), key)

    @property
    def mean(self) -> float:
        """Mean length of a point in terms; points without a term count."""
        if self._mean is None:
            self._mean = float((self.bags().agg(F.sum("dl")).first()[0] or 0) / max(self.n, 1) or 1.0)
        return self._mean

    def saturated(self, tf: Column, dl: Column) -> Column:
        """Okapi weight of a term: saturated tf over the measured mean length."""
        k, b = P.BM25_K1, P.BM25_B
        return tf * (k + 1) / (tf + k * (1 - b + b * dl / F.lit(self.mean)))

    def weights(self) -> DataFrame:
        """(point_id, term, tf, weight)."""
        return self.postings.select("point_id", "term", "tf", self.saturated(F.col("tf"), F.col("dl")).alias("weight"))

    def bags(self) -> DataFrame:
        """One row a point (see ``evigrid.operators.bags``)."""
        return self._bags

    def searchable(self) -> DataFrame:
        return self.bags().where("not is_quarantined").drop("is_quarantined")

    def blocks(self) -> DataFrame:
        """Posting blocks (see ``posting_blocks``); written once."""
        if self._blocks is None:
            self._blocks = stored(posting_blocks(self.postings, self.n))
        return self._blocks

    def vectors(self) -> DataFrame:
        """(point_id, bucket, w)."""
        return self.embed(self.points, "point_id", "content")

    def vector_rows(self) -> DataFrame:
        """One row a searchable point: the columns of ``live``, buckets b and weights w; written once."""
        if self._vectors is None and self.embed == self._hashed:
            self._vectors = stored(unit_rows(self.searchable(), self.idf, self.dims, TERMS_SENT))
        if self._vectors is None:
            rows = self.vectors().groupBy("point_id").agg(F.collect_list(F.struct("bucket", "w")).alias("v"))
            self._vectors = stored(rows.join(self.live, "point_id").select(*self.live.columns, F.col("v.bucket").alias("b"), F.col("v.w").alias("w")))
        return self._vectors


def build_index(points: DataFrame, **options) -> Index:
    """Write the tables that searches read."""
    return Index(points, **options)


def _top(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "point_id")
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n).withColumn("rank", F.col("rank").cast("long"))


def dense_topk(questions: DataFrame, index: Index, scope: DataFrame, n: int = P.PREFETCH_DENSE) -> DataFrame:
    """(qid, point_id, score, rank) by cosine: blocks of questions against stored vectors, scope before ranking.

    scope: qid, scope (one project, null for all) and, where questions are bound to documents, ``documents``
    (a list of ids; null or empty for all).
    """
    q = index.embed(questions.select("qid", "question"), "qid", "question")
    asked = q.groupBy("qid").agg(F.collect_list(F.struct("bucket", "w")).alias("v")).join(scope, "qid").select(*scope.columns, F.col("v.bucket").alias("b"), F.col("v.w").alias("w"))
    return _top(sparse_vector_topk(asked, index.vector_rows(), index.dims, n), n)


def sparse_topk(questions: DataFrame, index: Index, scope: DataFrame, n: int = P.PREFETCH_SPARSE) -> DataFrame:
    """(qid, point_id, score, rank) by Okapi weights; only points that share a term.

    Exact: bags are read once for a block of questions.  (Where few questions meet posting blocks that are kept,
    ``evigrid.operators.pruning`` reads less.)
    """
    asked = questions.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term")).join(index.terms("idf"), "term")
    asked = asked.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("v")).join(scope, "qid").select(*scope.columns, F.col("v.term").alias("t"), F.col("v.idf").alias("w"))
    return _top(weighted_topk(asked, index.searchable(), index.mean, n), n)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = P.RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(qid, point_id, score, rank) of the union; ties in dense order first, then sparse order."""
    d = dense.select("qid", "point_id", F.col("rank").alias("dense_rank"), F.col("score").alias("cosine"))
    s = sparse.select("qid", "point_id", F.col("rank").alias("sparse_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    both = d.join(s, ["qid", "point_id"], "full").withColumn("score", F.round(part("dense_rank", weights[0]) + part("sparse_rank", weights[1]), 9))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return both.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).select("qid", "point_id", "score", "rank", "cosine")


def fused_cut(fused: DataFrame, n: int = P.FUSED_TOP_K) -> DataFrame:
    return fused.where(F.col("rank") < n)


def doc_quota(fused: DataFrame, points: DataFrame, quota: int = P.DOC_QUOTA, cap: int = P.FUSED_TOP_K) -> DataFrame:
    """At most ``quota`` per document first, the overflow behind in rank order, up to ``cap``."""
    rows = fused.join(points.select("point_id", "document_id"), "point_id")
    over = F.row_number().over(Window.partitionBy("qid", "document_id").orderBy("rank")) > quota
    order = Window.partitionBy("qid").orderBy("over", "rank")
    return rows.withColumn("over", over).withColumn("new", (F.row_number().over(order) - 1).cast("long")).where(F.col("new") < cap).select("qid", "point_id", "document_id", "score", F.col("new").alias("rank"), "cosine")


def join_back(quota: DataFrame, points: DataFrame, k: int = P.CONTEXT_TOP_K) -> DataFrame:
    """The first k candidates with their texts, in candidate order."""
    first = quota.where(F.col("rank") < k).select("qid", "point_id", "rank", "score", "cosine")
    return first.join(points, "point_id")


def guardrails(hydrated: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows out of scope, quarantined or deleted go and are not replaced; ranks are counted again."""
    ok = hydrated.join(scope, "qid").where("(scope is null or scope = project_id) and not is_quarantined and not deleted")
    if "documents" in scope.columns:
        ok = ok.where("documents is null or size(documents) = 0 or array_contains(documents, document_id)")
    ok = ok.drop(*(c for c in scope.columns if c != "qid"))
    return ok.withColumn("rank", (F.row_number().over(Window.partitionBy("qid").orderBy("rank")) - 1).cast("long"))


def retrieve(questions: DataFrame, index: Index, scope: DataFrame, k: int = P.CONTEXT_TOP_K) -> DataFrame:
    """The whole chain on a stored index: both searches, fusion, cut, quota, texts, guard-rails."""
    fused = rrf_fuse(dense_topk(questions, index, scope), sparse_topk(questions, index, scope))
    quota = stored(doc_quota(fused_cut(fused), index.points))
    return guardrails(join_back(quota, index.points, k), scope)


def rewrite_fusion(lists: DataFrame, weights: tuple[float, ...] = (P.WEIGHT_ORIGINAL, P.WEIGHT_REWRITE), k: int = P.RRF_K) -> DataFrame:
    """(qid, variant, point_id, rank) of a question (variant 0) and its rewrites -> (qid, point_id, score, rank)."""
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("variant") + 1)
    sums = lists.groupBy("qid", "point_id").agg(F.round(F.sum(w / (k + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "point_id")
    return sums.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def signals(questions: DataFrame, dense: DataFrame, fused: DataFrame, kept: DataFrame) -> DataFrame:
    """Greatest cosine before the guard-rails (0 without a candidate), fused and surviving counts."""
    top = dense.groupBy("qid").agg(F.max("score").alias("m"))
    n = fused.groupBy("qid").agg(F.count(F.lit(1)).alias("f"))
    h = kept.groupBy("qid").agg(F.count(F.lit(1)).alias("h"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return questions.select("qid").join(top, "qid", "left").join(n, "qid", "left").join(h, "qid", "left").select("qid", F.coalesce("m", F.lit(0.0)).alias("max_cosine"), zero(F.col("f")).alias("retrieved_count"), zero(F.col("h")).alias("hydrated_count"))


def abstain_gate(signal: DataFrame, threshold: float = P.OFFTOPIC_THRESHOLD) -> DataFrame:
    return signal.withColumn("abstain", (F.col("hydrated_count") == 0) | (F.col("max_cosine") < threshold))


def contained(anchors: DataFrame, texts: DataFrame, key: str, anchor: str, text: str, text_key: str) -> DataFrame:
    """Keys of anchors that are a substring of any text; both are normalised texts.

    A word inside an anchor stands between blanks, so it is a whole word of any
    text that holds the anchor: the longest one is the key of an equi-join on
    (text key, word) rows, and texts join the pairs it leaves.  Anchors under three
    words, where there are any, are compared with all texts.
    """
    words = F.split(anchor, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    keyed = stored(anchors.select(key, anchor, F.when(F.size(words) > 2, longest).alias("_w")))
    each = texts.select(F.col(text_key).alias("_id"), F.explode(F.split(text, " ")).alias("_w"))
    asked = keyed.where("_w is not null")
    pairs = each.join(asked.select("_w").distinct(), "_w", "left_semi").distinct().join(asked, "_w").select("_id", key, anchor)
    found = texts.select(F.col(text_key).alias("_id"), F.col(text).alias("_t")).join(pairs, "_id").where(F.contains("_t", anchor)).select(key)
    short = keyed.where(F.col("_w").isNull() & (F.col(anchor) != "")).select(key, anchor)
    if not short.isEmpty():  # no word to join on
        found = found.unionByName(texts.select(F.col(text).alias("_t")).join(short, F.contains("_t", anchor)).select(key))
    return found.distinct()

"""Index building and hybrid retrieval over documents, one query an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid import params as P
from evigrid.operators import retrieval as R
from evigrid.plans import query
from evigrid.session import stored, table
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql

#: The retrieval steps in SQL; a statement reads the last one that it needs.
STEPS = {
    "points_": "SELECT document_id AS point_id, * FROM docs",
    "toks": "SELECT point_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS term FROM points_",
    "post": "SELECT point_id, term, count(*) AS tf FROM toks GROUP BY ALL",
    "lens": "SELECT point_id, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS dl FROM points_",
    "idf": "SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM points_) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term",
    "wts": "SELECT point_id, term, tf, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens))) AS weight FROM post JOIN lens USING (point_id)",
    "dv0": "SELECT point_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 1024 AS bucket, sum(tf * idf) AS w FROM post JOIN idf USING (term) GROUP BY ALL",
    "dv": "SELECT point_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY point_id)) AS w FROM dv0",
    "qt": "SELECT qid, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+')) AS term FROM golden",
    "qv0": "SELECT qid, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 1024 AS bucket, sum(idf) AS w FROM qt JOIN idf USING (term) GROUP BY ALL",
    "qv": "SELECT qid, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS wq FROM qv0",
    "live": "SELECT point_id, project_id, qid FROM points_ JOIN scope ON scope IS NULL OR scope = project_id WHERE NOT is_quarantined",
    "ds": "SELECT qid, point_id, round(sum(w * wq), 6) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL",
    "dense": "SELECT * FROM (SELECT qid, point_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) - 1 AS rank FROM ds JOIN live USING (qid, point_id)) WHERE rank < 40",
    "ss": "SELECT qid, point_id, round(sum(weight * idf), 6) AS score FROM wts JOIN (SELECT DISTINCT qid, term FROM qt) USING (term) JOIN idf USING (term) GROUP BY ALL",
    "sparse": "SELECT * FROM (SELECT qid, point_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) - 1 AS rank FROM ss JOIN live USING (qid, point_id)) WHERE rank < 40",
    "fz": "SELECT qid, point_id, d.score AS cosine, d.rank AS dr, s.rank AS sr, round(coalesce(1.0::DOUBLE / (10 + d.rank), 0) + coalesce(1.0::DOUBLE / (10 + s.rank), 0), 9) AS score FROM dense d FULL JOIN sparse s USING (qid, point_id)",
    "fused": "SELECT qid, point_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) - 1 AS rank, cosine FROM fz",
    "quota0": "SELECT qid, point_id, point_id AS document_id, score, rank, cosine, row_number() OVER (PARTITION BY qid, point_id ORDER BY rank) > 4 AS over FROM fused WHERE rank < 20",
    "quota": "SELECT * FROM (SELECT qid, point_id, document_id, score, row_number() OVER (PARTITION BY qid ORDER BY over, rank) - 1 AS rank, cosine FROM quota0) WHERE rank < 20",
    "hyd": "SELECT qid, q.rank, q.score, q.cosine, p.* FROM quota q JOIN points_ p USING (point_id) WHERE rank < 8",
    "kept": "SELECT h.* REPLACE (row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS rank) FROM hyd h JOIN scope USING (qid) WHERE (scope IS NULL OR scope = project_id) AND NOT is_quarantined AND NOT deleted",
    "sig": "SELECT g.qid, coalesce((SELECT max(score) FROM dense d WHERE d.qid = g.qid), 0) AS max_cosine, (SELECT count(*) FROM fused f WHERE f.qid = g.qid) AS retrieved_count, (SELECT count(*) FROM kept k WHERE k.qid = g.qid) AS hydrated_count FROM golden g",
}


def sql(body: str, **more: str) -> str:
    return with_sql("docs golden scope", body, **STEPS, **more)


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.docs(spark, sf_dir).withColumn("point_id", F.col("document_id"))


class Run:
    """The retrieval chain over one folder of tables; costly steps are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.points, self.questions = points_of(spark, sf_dir), X.golden(spark, sf_dir)
        self.scope, self._index = X.scope(self.questions), None

    @property
    def index(self) -> R.Index:
        if self._index is None:
            self._index = R.build_index(self.points)
        return self._index

    def dense(self):
        return R.dense_topk(self.questions, self.index, self.scope)

    def sparse(self):
        return R.sparse_topk(self.questions, self.index, self.scope)

    def fused(self):
        return R.rrf_fuse(self.dense(), self.sparse())

    def quota(self):
        return R.doc_quota(R.fused_cut(self.fused()), self.points)

    def hydrated(self):
        return R.join_back(stored(self.quota()), self.points)

    def kept(self):
        return R.retrieve(self.questions, self.index, self.scope)

    def signals(self):
        dense = stored(self.dense())
        fused = stored(R.rrf_fuse(dense, self.sparse()))
        kept = R.guardrails(R.join_back(R.doc_quota(R.fused_cut(fused), self.points), self.points), self.scope)
        return R.signals(self.questions, dense, fused, kept)


@query(sql("SELECT point_id, term, tf, round(weight, 6) AS weight FROM wts"))
def sparse_postings(spark, sf_dir):
    return R.build_index(points_of(spark, sf_dir)).weights().select("point_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query(sql("SELECT term, df, round(idf, 6) AS idf FROM idf"))
def idf_stats(spark, sf_dir):
    return R.build_index(points_of(spark, sf_dir)).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(sql("SELECT point_id, bucket, round(w, 6) AS w FROM dv"))
def dense_vectors(spark, sf_dir):
    return R.build_index(points_of(spark, sf_dir)).vectors().withColumn("w", F.round("w", 6))


@query(sql("SELECT point_id, project_id, document_id, 'text' AS modality, sha256(content) AS content_hash, 'text-embedding-3-large' AS embedding_model, 1024 AS embedding_dims, 0 AS ingest_generation, false AS quarantined FROM points_"))
def point_payload(spark, sf_dir):
    return points_of(spark, sf_dir).select("point_id", "project_id", "document_id", F.lit("text").alias("modality"), F.sha2("content", 256).alias("content_hash"), F.lit(P.EMBEDDING_MODEL).alias("embedding_model"), F.lit(P.EMBEDDING_DIMS).alias("embedding_dims"), F.lit(0).alias("ingest_generation"), F.lit(False).alias("quarantined"))


_KEY = "SELECT 'text-embedding-3-large:1024:' || sha256('[Paper]' || chr(10) || content) AS k, document_id, greatest(1, length('[Paper]' || chr(10) || content) // 4) AS tokens FROM docs"


def _cache(spark, sf_dir) -> DataFrame:
    """Texts with their cache key; the cache holds the keys of documents with document_id % 3 = 0."""
    text = F.concat(F.lit("[Paper]\n"), F.col("content"))
    return X.docs(spark, sf_dir).select("document_id", F.concat(F.lit(f"{P.EMBEDDING_MODEL}:{P.EMBEDDING_DIMS}:"), F.sha2(text, 256)).alias("k"), F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long").alias("tokens"))


@query(with_sql("docs", "SELECT e.k, count(*) AS texts, bool_or(c.k IS NOT NULL) AS hit, min(e.document_id) AS computed_for FROM e LEFT JOIN c ON e.k = c.k GROUP BY e.k", e=_KEY, c="SELECT DISTINCT k FROM e WHERE document_id % 3 = 0"))
def embedding_cache_join(spark, sf_dir):
    """Hits reuse a vector; each distinct missing text is computed once, for its first document."""
    e = _cache(spark, sf_dir)
    asked = e.groupBy("k").agg(F.count(F.lit(1)).alias("texts"), F.min("document_id").alias("computed_for"))
    return asked.join(e.where("document_id % 3 = 0").select("k").distinct().withColumn("c", F.lit(True)), "k", "left").select("k", "texts", F.coalesce("c", F.lit(False)).alias("hit"), "computed_for")


@query(with_sql("docs", "SELECT count(*) FILTER (c.k IS NOT NULL) AS cached_count, count(*) FILTER (c.k IS NULL) AS billed_count, CAST(coalesce(sum(tokens) FILTER (c.k IS NULL), 0) AS BIGINT) AS billed_tokens, round(coalesce(sum(tokens) FILTER (c.k IS NULL), 0) / 1e6::DOUBLE * 0.13::DOUBLE, 9) AS cost_usd FROM u LEFT JOIN c ON u.k = c.k", e=_KEY, c="SELECT DISTINCT k FROM e WHERE document_id % 3 = 0", u="SELECT k, max(tokens) AS tokens FROM e GROUP BY k"))
def embed_usage(spark, sf_dir):
    e = _cache(spark, sf_dir)
    u = e.groupBy("k").agg(F.max("tokens").alias("tokens"), F.count_if(F.col("document_id") % 3 == 0).alias("in_cache"))
    miss = F.col("in_cache") == 0
    return u.agg(F.count_if(~miss).alias("cached_count"), F.count_if(miss).alias("billed_count"), F.coalesce(F.sum(F.when(miss, F.col("tokens"))), F.lit(0)).alias("billed_tokens")).withColumn("cost_usd", F.round(F.col("billed_tokens") / 1e6 * P.EMBEDDING_USD_PER_MILLION, 9))


@query(sql("SELECT qid, count(*) AS points FROM live GROUP BY qid"))
def scope_filter(spark, sf_dir):
    r = Run(spark, sf_dir)
    per = stored(r.points.where("not is_quarantined").groupBy("project_id").agg(F.count(F.lit(1)).alias("n")))  # counts per project, not pairs
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number, for questions without a scope
    own = r.scope.join(per.withColumnRenamed("project_id", "scope"), "scope", "left")
    return own.select("qid", F.when(F.col("scope").isNull(), total).otherwise(F.col("n")).alias("points")).where("points > 0")


@query(sql("SELECT qid, point_id, score, rank FROM dense"))
def dense_topk(spark, sf_dir):
    return Run(spark, sf_dir).dense()


@query(sql("SELECT qid, point_id, score, rank FROM sparse"))
def sparse_topk(spark, sf_dir):
    return Run(spark, sf_dir).sparse()


@query(sql("SELECT qid, point_id, score, rank, cosine FROM fused"))
def rrf_fuse(spark, sf_dir):
    return Run(spark, sf_dir).fused()


@query(sql("SELECT qid, point_id, score, rank, cosine FROM fused WHERE rank < 20"))
def fused_cut(spark, sf_dir):
    return R.fused_cut(Run(spark, sf_dir).fused())


@query(with_sql("docs golden scope", "SELECT qid, point_id, project_id AS document_id, score, rank, cosine FROM q2 WHERE rank < 20", **STEPS, q1="SELECT f.*, project_id, row_number() OVER (PARTITION BY qid, project_id ORDER BY rank) > 4 AS over FROM fused f JOIN points_ USING (point_id) WHERE rank < 20", q2="SELECT qid, point_id, project_id, score, cosine, row_number() OVER (PARTITION BY qid ORDER BY over, rank) - 1 AS rank FROM q1"))
def doc_quota(spark, sf_dir):
    """The quota per source, where several points share the quota's key."""
    r = Run(spark, sf_dir)
    return R.doc_quota(R.fused_cut(r.fused()), r.points.withColumn("document_id", F.col("project_id")))


@query(sql("SELECT qid, point_id, rank, score, title, content FROM hyd"))
def join_back(spark, sf_dir):
    return Run(spark, sf_dir).hydrated().select("qid", "point_id", "rank", "score", "title", "content")


@query(sql("SELECT qid, point_id, rank, score FROM kept"))
def guardrails(spark, sf_dir):
    return Run(spark, sf_dir).kept().select("qid", "point_id", "rank", "score")


@query(sql("SELECT * FROM sig"))
def retrieval_signals(spark, sf_dir):
    return Run(spark, sf_dir).signals()


@query(sql("SELECT *, hydrated_count = 0 OR max_cosine < 0.28 AS abstain FROM sig"))
def abstain_gate(spark, sf_dir):
    return R.abstain_gate(Run(spark, sf_dir).signals())


#: Questions under (qid, variant): the question, and as its rewrite the last six of its words.
_VARIANTS = "SELECT qid * 2 + v AS qid, CASE WHEN v = 0 THEN question ELSE array_to_string(list_slice(string_split(question, ' '), -6, -1), ' ') END AS question FROM golden, (SELECT unnest([0, 1]) AS v)"


@query(with_sql(
    "docs golden", "SELECT qid, point_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) - 1 AS rank FROM wz",
    gv=_VARIANTS, scope="SELECT qid * 2 + v AS qid, CASE WHEN qid % 4 = 0 THEN 'src' || CAST(qid % 20 AS VARCHAR) END AS scope FROM golden, (SELECT unnest([0, 1]) AS v)",
    **{k: v.replace("golden", "gv") for k, v in STEPS.items() if k in ("points_", "toks", "post", "lens", "idf", "wts", "qt", "live", "ss", "sparse")},
    wz="SELECT qid // 2 AS qid, point_id, round(sum(CASE WHEN qid % 2 = 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (10 + rank)), 9) AS score FROM sparse GROUP BY ALL",
))
def weighted_rewrite_fusion(spark, sf_dir):
    """The lists of a question and of its rewrite, fused with a weight for each."""
    r = Run(spark, sf_dir)
    both = lambda df: df.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("qid", F.col("qid") * 2 + F.col("v"))
    words = F.split("question", " ")
    asked = both(r.questions).withColumn("question", F.when(F.col("v") == 0, F.col("question")).otherwise(F.array_join(F.slice(words, F.greatest(F.size(words) - 5, F.lit(1)), 6), " ")))
    lists = R.sparse_topk(asked.select("qid", "question"), r.index, both(r.scope).select("qid", "scope"))
    return R.rewrite_fusion(lists.select(F.floor(F.col("qid") / 2).alias("qid"), (F.col("qid") % 2).cast("int").alias("variant"), "point_id", "rank"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT qid, vec_id AS point_id, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> qid)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) - 1 AS rank FROM s) WHERE rank < 40""")
def vector_topk(spark, sf_dir):
    """Stored vectors against a stated question set, exact, in blocks of a matrix product."""
    from evigrid.operators.vectors import exact_topk

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    return exact_topk(rows.where("point_id % 100 = 0").withColumnRenamed("point_id", "qid"), rows, P.PREFETCH_DENSE)


_HITS = dict(
    STEPS,
    want="SELECT qid, grp, lower(trim(regexp_replace(anchor, '[ \\t\\r\\n]+', ' ', 'g'))) AS a FROM golden",
    txt="SELECT lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))) AS t FROM docs WHERE NOT deleted",
    expect="SELECT qid, grp, CASE WHEN EXISTS (SELECT 1 FROM txt WHERE contains(t, a)) THEN 'answer' ELSE 'abstain' END AS expect FROM want",
    rec="SELECT e.qid, e.grp, e.expect, coalesce(bool_or(contains(lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))), a)), false) AS hit FROM expect e JOIN want USING (qid) LEFT JOIN kept USING (qid) GROUP BY ALL",
)


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, grp, anchor, expect: whether any live document holds the anchor."""
    from evigrid.functions.text import normalize

    g = X.golden(spark, sf_dir).withColumn("a", normalize(F.col("anchor")))
    texts = X.docs(spark, sf_dir).where("not deleted").select("document_id", normalize(F.col("content")).alias("t"))
    return g.join(R.contained(g, texts, "qid", "a", "t", "document_id").withColumn("x", F.lit("answer")), "qid", "left").select("qid", "grp", "a", F.coalesce("x", F.lit("abstain")).alias("expect"))


def recalls(spark: SparkSession, sf_dir: str, kept: DataFrame | None = None) -> DataFrame:
    from evigrid.functions.text import normalize

    e, kept = expectations(spark, sf_dir), Run(spark, sf_dir).kept() if kept is None else kept
    found = kept.join(e.select("qid", "a"), "qid").where((F.col("a") != "") & F.contains(normalize(F.col("content")), F.col("a"))).select("qid").distinct().withColumn("hit", F.lit(True))
    return e.join(found, "qid", "left").select("qid", "grp", "expect", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(with_sql("docs golden scope", "SELECT qid, hit FROM rec WHERE expect = 'answer'", **_HITS))
def recall_at_k(spark, sf_dir):
    return recalls(spark, sf_dir).where("expect = 'answer'").select("qid", "hit")


@query(with_sql("docs golden scope", "SELECT qid, grp, expect FROM expect", **_HITS))
def load_golden(spark, sf_dir):
    return expectations(spark, sf_dir).select("qid", "grp", "expect")


@query(with_sql("docs golden scope", "SELECT expect, round(min(max_cosine), 6) AS lo, round(avg(max_cosine), 6) AS mean, round(max(max_cosine), 6) AS hi FROM sig JOIN expect USING (qid) GROUP BY expect", **_HITS))
def gate_calibration(spark, sf_dir):
    s = Run(spark, sf_dir).signals().join(expectations(spark, sf_dir), "qid")
    return s.groupBy("expect").agg(F.round(F.min("max_cosine"), 6).alias("lo"), F.round(F.avg("max_cosine"), 6).alias("mean"), F.round(F.max("max_cosine"), 6).alias("hi"))


_RR = "SELECT ks.k, qid, point_id, row_number() OVER (PARTITION BY ks.k, qid ORDER BY round(coalesce(1.0::DOUBLE / (ks.k + dr), 0) + coalesce(1.0::DOUBLE / (ks.k + sr), 0), 9) DESC, dr NULLS LAST, sr NULLS LAST) AS place FROM fz, ks"


@query(with_sql("docs golden scope", "SELECT k, round(avg(coalesce(1.0::DOUBLE / p, 0)), 6) AS mrr FROM (SELECT ks.k, e.qid, min(place) FILTER (place <= 10 AND contains(lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))), a)) AS p FROM ks, expect e JOIN want USING (qid) LEFT JOIN rr ON rr.qid = e.qid AND rr.k = ks.k LEFT JOIN points_ USING (point_id) WHERE expect = 'answer' GROUP BY ALL) GROUP BY k", **_HITS, ks="SELECT unnest([2, 10, 20]) AS k", rr=_RR))
def k_sweep_mrr(spark, sf_dir):
    """Mean reciprocal rank at 10 for three fusion constants; the lists are ranked once."""
    from evigrid.functions.text import normalize

    r, e = Run(spark, sf_dir), expectations(spark, sf_dir).where("expect = 'answer'")
    dense, sparse = stored(r.dense()), stored(r.sparse())
    out = None
    for k in (2, 10, 20):
        f = R.rrf_fuse(dense, sparse, k).where("rank < 10").join(r.points.select("point_id", "content"), "point_id").join(e.select("qid", "a"), "qid")
        best = f.where(F.contains(normalize(F.col("content")), F.col("a"))).groupBy("qid").agg((1.0 / (F.min("rank") + 1)).alias("rr"))
        m = e.select("qid").join(best, "qid", "left").agg(F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr")).select(F.lit(k).alias("k"), "mrr")
        out = m if out is None else out.unionByName(m)
    return out

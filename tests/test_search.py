"""Stored indexes: re-ingest by document, exact search by bounds, lists of documents, segment stores, caches."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evigrid import params as P
from evigrid.functions.fuzzy import partial_ratio, plain
from evigrid.operators import pruning, retrieval as R, store as spark_store
from evigrid.operators.chunk_store import ChunkStore
from evigrid.operators.neighbours import ProjectionIndex, recall
from evigrid.operators.store import SegmentStore, upsert_sink
from evigrid.operators.vector_cache import VectorCache
from evigrid.operators.vectors import exact_topk
from evigrid.session import shared_dir

POINT = "point_id long, document_id long, project_id string, content string, is_quarantined boolean, deleted boolean"


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [(i, i // 3, f"p{i % 3}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randint(3, 60))), i % 17 == 0, False) for i in range(n)]


def questions(spark, n=12, seed=2):
    rng = random.Random(seed)
    rows = [(q, " ".join(f"w{rng.choice([0, 1, 2, 5, rng.randrange(400), rng.randrange(400)])}" for _ in range(8))) for q in range(n)]
    return spark.createDataFrame(rows, "qid long, question string")


def plain_sparse(index, asked, scope, n):
    """All postings of asked terms, without any bound."""
    q = asked.select("qid", F.explode(F.array_distinct(R.terms(F.col("question")))).alias("term")).join(index.idf.select("term", "idf"), "term")
    s = q.join(index.weights(), "term").groupBy("qid", "point_id").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))
    ok = s.join(index.live, "point_id").join(scope, "qid").where("scope is null or scope = project_id")
    if "documents" in scope.columns:
        ok = ok.where("documents is null or size(documents) = 0 or array_contains(documents, document_id)")
    return R._top(ok.select("qid", "point_id", "score"), n)


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "point_id", "score", "rank").collect())


@pytest.mark.parametrize("block, first", [(1024, 8), (16, 1)])
def test_pruned_search_is_exact(spark, monkeypatch, block, first):
    monkeypatch.setattr(pruning, "BLOCK", block)
    monkeypatch.setattr(pruning, "FIRST", first)
    index, asked = R.build_index(spark.createDataFrame(texts(300), POINT)), questions(spark)
    scope = asked.select("qid", F.when(F.col("qid") % 3 == 0, F.lit("p1")).alias("scope"))
    assert rows(R.sparse_topk(asked, index, scope, 5)) == rows(plain_sparse(index, asked, scope, 5))
    lists = F.when(F.col("qid") % 4 == 1, F.array(F.lit(7))).when(F.col("qid") % 4 == 2, F.array(*map(F.lit, range(5, 10)))).when(F.col("qid") % 4 == 3, F.array().cast("array<int>"))
    listed = scope.withColumn("documents", lists.cast("array<bigint>"))
    got = R.sparse_topk(asked, index, listed, 5)
    assert rows(got) == rows(plain_sparse(index, asked, listed, 5))
    assert {r.point_id // 3 for r in got.where("qid % 4 = 1").collect()} <= {7}
    assert {r.point_id // 3 for r in R.dense_topk(asked, index, listed, 5).where("qid % 4 = 2").collect()} <= set(range(5, 10))


def test_few_pairs_are_looked_at(spark):
    """Far fewer points are summed than share a term with a question."""
    index, asked = R.build_index(spark.createDataFrame(texts(3000), POINT)), questions(spark)
    scope = asked.select("qid", F.lit(None).cast("string").alias("scope"))
    q = asked.select("qid", F.explode(F.array_distinct(R.terms(F.col("question")))).alias("term")).join(index.terms("df", "idf"), "term")
    looked, shared = pruning.scored(q, index, scope, 2).count(), q.join(index.postings, "term").select("qid", "point_id").distinct().count()
    assert looked < 0.2 * shared


def test_index_follows_its_documents(spark):
    """Changed, removed and new documents: the index equals one built anew, in searches too."""
    old, new = texts(60), texts(60, seed=9)
    store = ChunkStore(spark, f"{shared_dir(spark)}/i")
    store.put(spark.createDataFrame(old, POINT))
    changed = [r for r in new if r[1] in (2, 5)] + [(1000, 99, "p0", "w1 brand new text", False, False)]
    gone = spark.createDataFrame([(d,) for d in (2, 5, 7, 99)], "document_id long")
    store.put(spark.createDataFrame(changed, POINT), gone)
    want = R.build_index(spark.createDataFrame([r for r in old if r[1] not in (2, 5, 7)] + changed, POINT))
    terms = lambda i: sorted((r.term, r.df, round(r.idf, 9)) for r in i.idf.collect())
    held = lambda i: sorted((r.point_id, r.term, r.tf, r.dl) for r in i.postings.select("point_id", "term", "tf", "dl").collect())
    for _ in range(2):
        index = store.index()
        assert index.n == want.n and terms(index) == terms(want) and held(index) == held(want) and abs(index.mean - want.mean) < 1e-9
        asked = questions(spark, 4)
        scope = asked.select("qid", F.lit(None).cast("string").alias("scope"))
        for search in (R.sparse_topk, R.dense_topk):
            assert rows(search(asked, index, scope, 6)) == rows(search(asked, want, scope, 6))
        store.put(spark.createDataFrame([r for r in changed if r[1] == 5], POINT))  # the same again changes nothing


def test_segment_store(spark):
    store = SegmentStore(spark, f"{shared_dir(spark)}/s", "k")
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert store.replace(frame((1, "a"), (2, "b"), (2, "c"), (None, "n")), epoch=0)
    before = store.read()
    assert store.replace(frame((2, "x")), frame((2, ""), (1, ""), (None, "")), epoch=1)
    now = [(2, "x")]
    assert sorted(tuple(r) for r in store.read().collect()) == now
    assert not store.replace(frame((2, "y")), epoch=1)  # replayed
    assert sorted(tuple(r) for r in store.read().collect()) == now
    assert before.count() == 4  # an open reader keeps its segments
    frame((2, "half")).write.parquet(f"{store.path}/segment-half/rows")  # a writer that died before its manifest row
    assert sorted(tuple(r) for r in store.read().collect()) == now
    store.compact()
    assert sorted(tuple(r) for r in store.read().collect()) == now and len(store._state()[1]) == 1
    put = upsert_sink(SegmentStore(spark, f"{shared_dir(spark)}/u", "k"))
    batch = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "d")], "k long, seq long, v string")
    for epoch in (0, 0):
        put(batch, epoch)
    assert put.__closure__[0].cell_contents.read().count() == 2


def test_vector_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(batch):
        calls.add(len(batch))
        return np.array([[len(t), t.count("a")] for t in batch], np.float32)

    cache = VectorCache(spark, f"{shared_dir(spark)}/v", embed, batch=2)
    docs = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "id long, text string")
    first = {r.id: (r.hit, list(r.vector)) for r in cache.vectors(docs.where("id < 3"), "id", "text").collect()}
    assert first == {1: (False, [2, 2]), 2: (False, [1, 0])} and calls.value == 2
    again = {r.id: (r.hit, list(r.vector)) for r in cache.vectors(docs, "id", "text").collect()}
    assert again == {1: (True, [2, 2]), 2: (True, [1, 0]), 3: (True, [2, 2]), 5: (False, [0, 0])} and calls.value == 3
    assert cache.vectors(docs, "id", "text").where("not hit").count() == 0 and calls.value == 3


def test_projection_neighbours(spark):
    """Clustered vectors: few probes find nearly all; vectors without structure: as many probes as it takes."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 600)] + 0.1 * rng.normal(size=(600, 16))).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9999, None)], "point_id long, embedding array<float>")
    asked = points.where("point_id % 20 = 0 and embedding is not null").withColumnRenamed("point_id", "qid")
    index = ProjectionIndex(points)
    found = index.topk(asked, 8)
    shares = [r.recall for r in recall(found, exact_topk(asked, points.where("embedding is not null"), 8)).collect()]
    assert index.probes < 32 and sum(shares) / len(shares) >= 0.9 and all(r.qid != r.point_id for r in found.collect())


def longest(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
        p = q
    return p[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abcé ", max_size=80), st.text("abcé ", max_size=90))
def test_partial_ratio(a, b):
    s, t = sorted((a, b), key=len)
    windows = {t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))} - {""}
    want = max((200 * longest(s, w) / (len(s) + len(w)) for w in windows), default=0.0) if s else 0.0 if t else 100.0
    assert abs(partial_ratio(a, b) - want) < 1e-9
    assert plain(" A-b_c! ") == "a b c" and P.GROUNDED_FROM == 60


def test_vectors_with_terms_that_are_not_sent(spark, monkeypatch):
    """Few sent terms, the rest joined by term: the same vectors as by the joined form, and postings equal a count by hand."""
    points = spark.createDataFrame(texts(200) + [(900, 300, "p0", "", False, False), (901, 300, "p0", "Solo solo", False, False)], POINT)
    index = R.build_index(points)
    held = {(r.point_id, r.term): (r.tf, r.dl) for r in index.postings.collect()}
    assert held == {(r.point_id, r.term): (r.tf, r.dl) for r in R.postings(points).collect()} and held[901, "solo"] == (2, 2)
    want = {(r.point_id, r.bucket): round(r.w, 9) for r in index.vectors().collect() if r.point_id % 17 or r.point_id >= 900}
    for sent in (10**6, 40, 0):
        monkeypatch.setattr(R, "TERMS_SENT", sent)
        index._vectors = None
        got = {(r.point_id, b): round(w, 9) for r in index.vector_rows().collect() for b, w in zip(r.b, r.w)}
        assert got == want
    plan = R.bags(points, "content", "point_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_gates_run_the_retrieval_once(spark, sf, monkeypatch):
    from evigrid.plans import evidence

    runs, init = [], evidence.Answered.__init__
    monkeypatch.setattr(evidence.Answered, "__init__", lambda self, *a: (runs.append(1), init(self, *a))[1])
    got = {r.gate for r in evidence.hard_gates(spark, sf).collect()}
    assert got == {"recall", "id_validity", "quote", "abstain"} and len(runs) == 1


def test_cells_are_summed_in_order():
    """Cells of many rows, over several steps, equal the sums by sorted cell to the last bit."""
    from evigrid.operators.bags import cells

    rng = np.random.default_rng(5)
    row = np.sort(rng.integers(0, 3000, 20_000))
    bucket, x = rng.integers(0, 64, 20_000), rng.random(20_000)
    cell, place = np.unique(row * 64 + bucket, return_inverse=True)
    got = cells(row, bucket, x, 3000, 64)
    assert all((a == b).all() for a, b in zip(got, (cell // 64, cell % 64, np.bincount(place, x))))
    assert [len(c) for c in cells(row[:0], bucket[:0], x[:0], 0, 64)] == [0, 0, 0]


def test_only_lines_of_asked_tables_are_gathered(spark, sf):
    """Tables of evidence are made from their own lines, not picked from those of all orders."""
    from evigrid.sources import fixtures as X

    whole = X.table_text(spark, sf)
    of = whole.where("table_id % 50 = 3").select("table_id").distinct()
    asked = X.table_text(spark, sf, of)
    want = sorted(map(tuple, whole.where("table_id % 50 = 3").collect()), key=lambda r: r[0])
    assert want and sorted(map(tuple, asked.collect()), key=lambda r: r[0]) == want
    assert X.table_text(spark, sf, of.limit(0)).isEmpty()


def shuffled(spark):
    """Bytes that all exchanges so far wrote."""
    time.sleep(0.5)  # the session's own figures follow its tasks a little later
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_put_deals_out_frequencies_alone(spark):
    """Neither texts nor postings go through an exchange when points are indexed or put again, and chunks are written once."""
    points = spark.createDataFrame([(i, i, "p0", " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(120)), False, False) for i in range(3000)], POINT).repartition(4)
    store = ChunkStore(spark, f"{shared_dir(spark)}/i")
    path = f"{shared_dir(spark)}/p"
    points.write.parquet(path)
    points = spark.read.parquet(path)
    before = shuffled(spark)
    store.put(points)
    store.put(store.read().where("document_id % 10 = 3"))
    assert store.live().count() == 3000 and store.index().n == 3000
    assert shuffled(spark) - before < 150_000  # each of the bags alone is larger


def test_wide_rows_stay_where_they_are(spark, monkeypatch):
    """Rows of earlier segments meet the later segments' keys without an exchange of their own where keys are few; otherwise the rows are the same."""
    store = SegmentStore(spark, f"{shared_dir(spark)}/s", "k")
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    store.replace(frame((1, "a"), (2, "b"), (3, "c"), (None, "n")))
    store.replace(frame((2, "x"), (2, "y")))
    store.replace(frame((3, "z")), frame((3, ""), (None, "")))
    want = [(1, "a", 0), (2, "x", 1), (2, "y", 1), (3, "z", 2)]
    monkeypatch.setattr(spark_store, "KEYS_SENT", 0)
    assert sorted(map(tuple, store.live().collect())) == want
    monkeypatch.undo()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, store.live().collect())) == want
        assert "SortMergeJoin" not in store.live()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_with_their_terms(spark, monkeypatch):
    """Few sent terms and the rest dealt by term: the same rows as by one join."""
    index = R.build_index(spark.createDataFrame(texts(200), POINT))
    want = sorted(map(tuple, index.postings.select("point_id", "term").join(index.idf.select("term", "df"), "term").collect()))
    for sent in (10**6, 40, 0):
        monkeypatch.setattr(R, "TERMS_SENT", sent)
        got = index.with_terms(index.postings.select("point_id", "term"), "df")
        assert sorted(map(tuple, got.select("term", "point_id", "df").collect())) == want


def test_chunks_meet_their_documents_before_they_are_packed(spark, sf):
    """Chunks are not dealt out again for the columns of their documents."""
    from evigrid.plans.chunk_index import chunk_points

    plan = chunk_points(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]

"""Document status, reconciliation of the index, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evigrid import params as P
from evigrid.plans import query
from evigrid.session import stored, table
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql

_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in P.TRANSITIONS)
_LATEST = "SELECT document_id, arg_max(status, seq) AS status, max(ts) FILTER (status = 'processing') AS started FROM status_log GROUP BY document_id"


@query(with_sql("status_log", f"SELECT document_id, seq, prev, status FROM (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY seq) AS prev FROM status_log) WHERE prev IS NOT NULL AND status <> 'deleted' AND (prev, status) NOT IN ({_EDGES})"))
def validate_transitions(spark, sf_dir):
    """Steps of the log that are no edge of the allowed table."""
    log = X.status_log(spark, sf_dir).withColumn("prev", F.lag("status").over(Window.partitionBy("document_id").orderBy("seq")))
    edges = F.broadcast(spark.createDataFrame(list(P.TRANSITIONS), "prev string, status string"))
    return log.where("prev is not null and status <> 'deleted'").join(edges, ["prev", "status"], "left_anti").select("document_id", "seq", "prev", "status")


def latest(log: DataFrame) -> DataFrame:
    return log.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"), F.max(F.when(F.col("status") == "processing", F.col("ts"))).alias("started"))


@query(with_sql("status_log", "SELECT document_id, status FROM l", l=_LATEST))
def current_status(spark, sf_dir):
    return latest(X.status_log(spark, sf_dir)).select("document_id", "status")


@query(with_sql("status_log", "SELECT document_id, CASE WHEN stuck THEN 'failed' ELSE status END AS status, CASE WHEN stuck THEN 'STUCK_TIMEOUT' END AS error_code FROM (SELECT *, status = 'processing' AND document_id % 10 <> 0 AND started IS NOT NULL AND started < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 45 MINUTE AS stuck FROM l)", l=_LATEST))
def sweep_stuck(spark, sf_dir, now: str = "2024-01-31 00:00:00"):
    """Processing for longer than the limit: failed; ``now`` is a parameter."""
    old = F.col("started") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {P.STUCK_MINUTES} minutes")
    stuck = F.coalesce((F.col("status") == "processing") & (F.col("document_id") % 10 != 0) & old, F.lit(False))
    return latest(X.status_log(spark, sf_dir)).select("document_id", F.when(stuck, "failed").otherwise(F.col("status")).alias("status"), F.when(stuck, "STUCK_TIMEOUT").alias("error_code"))


@query(with_sql("status_log", "SELECT document_id % 20 AS project_id, count(*) AS documents, count(*) FILTER (status IN ('text_ready', 'full_ready')) AS queryable, count(*) FILTER (status IN ('full_ready', 'rejected', 'failed', 'deleted')) AS terminal FROM l GROUP BY 1", l=_LATEST))
def status_board(spark, sf_dir):
    s = latest(X.status_log(spark, sf_dir))
    return s.groupBy((F.col("document_id") % 20).alias("project_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status").isin("text_ready", "full_ready")).alias("queryable"), F.count_if(F.col("status").isin("full_ready", "rejected", "failed", "deleted")).alias("terminal"))


@query(with_sql("status_log", "SELECT document_id, CASE WHEN document_id % 17 = 0 THEN 'not_found' WHEN status = 'failed' THEN 'retry' ELSE 'conflict' END AS verdict FROM l", l=_LATEST))
def retry_eligibility(spark, sf_dir):
    return latest(X.status_log(spark, sf_dir)).select("document_id", F.when(F.col("document_id") % 17 == 0, "not_found").when(F.col("status") == "failed", "retry").otherwise("conflict").alias("verdict"))


@query(with_sql("docs", "SELECT event_id, e.user_id AS document_id FROM events e JOIN docs d ON d.document_id = e.user_id WHERE NOT d.deleted"))
def delete_race_guard(spark, sf_dir):
    """Later writes to a document that is gone or deleted are dropped: only live keys pass."""
    live = X.docs(spark, sf_dir).where("not deleted").select("document_id").distinct()
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id")).join(live, "document_id", "left_semi").select("event_id", "document_id")


@query("SELECT event_id, CAST(greatest(0, least(100, round_even(value / 500 * 100, 0))) AS INTEGER) AS pct FROM events")
def progress_pct(spark, sf_dir):
    """Half-even percentages of a fraction, here the value of an event over 500."""
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.col("value") / 500 * 100, 0))).cast("int").alias("pct"))


_LIVE = f"SELECT project_id, document_id AS id, sha256(content) AS h FROM docs WHERE NOT is_quarantined AND NOT deleted"
_REC = dict(
    lv=_LIVE,
    j=f"SELECT coalesce(l.project_id, p.project_id) AS project_id, coalesce(l.id, p.point_id) AS id, l.id IS NOT NULL AS live, p.point_id IS NOT NULL AS indexed, p.content_hash IS DISTINCT FROM l.h OR p.embedding_model IS DISTINCT FROM '{P.EMBEDDING_MODEL}' AS differs FROM lv l FULL JOIN points p ON l.project_id = p.project_id AND l.id = p.point_id",
)
_COUNTS = "count(*) FILTER (live) AS hydrated, count(*) FILTER (indexed) AS retrieved, count(*) FILTER (indexed AND NOT live) AS orphan, count(*) FILTER (live AND NOT indexed) AS missing, count(*) FILTER (live AND indexed AND differs) AS stale"


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.docs(spark, sf_dir).where("not is_quarantined and not deleted").select("project_id", F.col("document_id").alias("id"), F.sha2("content", 256).alias("h"))


@query(with_sql("docs", "SELECT project_id, id, h FROM l", l=_LIVE))
def live_chunks(spark, sf_dir):
    return live_rows(spark, sf_dir)


def classified(live: DataFrame, points: DataFrame) -> DataFrame:
    """Both sides by (project, id): one full outer join, differences with nulls counted as different."""
    l, p = live.withColumn("l", F.lit(True)), points.withColumnRenamed("point_id", "id").withColumn("p", F.lit(True))
    both = l.join(p, ["project_id", "id"], "full")
    differs = ~F.col("content_hash").eqNullSafe(F.col("h")) | ~F.col("embedding_model").eqNullSafe(F.lit(P.EMBEDDING_MODEL))
    return both.select("project_id", "id", F.col("l").isNotNull().alias("live"), F.col("p").isNotNull().alias("indexed"), differs.alias("differs"))


def _counts():
    l, p = F.col("live"), F.col("indexed")
    return [F.count_if(l).alias("hydrated"), F.count_if(p).alias("retrieved"), F.count_if(p & ~l).alias("orphan"), F.count_if(l & ~p).alias("missing"), F.count_if(l & p & F.col("differs")).alias("stale")]


_LOST = {"orphan": "indexed AND NOT live", "missing": "live AND NOT indexed", "stale": "live AND indexed AND differs"}
_SAMPLES = ", ".join(f"array_to_string(list_slice(list_sort(list(id) FILTER ({c})), 1, 10), ',') AS {k}_sample" for k, c in _LOST.items())


@query(with_sql("docs points", f"SELECT project_id, {_COUNTS}, {_SAMPLES} FROM j GROUP BY project_id", **_REC))
def reconcile(spark, sf_dir):
    """Counts per project and the ten least ids of each kind of difference; only differences are ranked."""
    c = stored(classified(live_rows(spark, sf_dir), X.points(spark, sf_dir)))
    kind = F.coalesce(*(F.when(F.expr(cond), k) for k, cond in _LOST.items()))
    rank = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy("id"))
    few = c.withColumn("kind", kind).where("kind is not null").withColumn("r", rank).where("r <= 10").groupBy("project_id").agg(
        *(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))), ",").alias(f"{k}_sample") for k in _LOST)
    )
    samples = [F.when(F.col(f"{k}_sample") != "", F.col(f"{k}_sample")).alias(f"{k}_sample") for k in _LOST]
    counts = c.groupBy("project_id").agg(*_counts())
    return counts.join(few, "project_id", "left").select(*counts.columns, *samples)


@query(with_sql("docs points", f"SELECT project_id, {_COUNTS} FROM j WHERE project_id IN (SELECT project_id FROM docs) GROUP BY GROUPING SETS ((project_id), ())", **_REC))
def reconcile_rollup(spark, sf_dir):
    known = X.docs(spark, sf_dir).select("project_id").distinct()
    c = classified(live_rows(spark, sf_dir), X.points(spark, sf_dir)).join(known, "project_id", "left_semi")
    return stored(c).groupingSets([["project_id"], []], "project_id").agg(*_counts())


@query(with_sql("messages", "SELECT conv_id, project_id, count(*) AS message_count FROM messages WHERE NOT deleted GROUP BY conv_id, project_id ORDER BY conv_id DESC"))
def conversation_list(spark, sf_dir):
    return X.messages(spark, sf_dir).where("not deleted").groupBy("conv_id", "project_id").agg(F.count(F.lit(1)).alias("message_count")).orderBy(F.desc("conv_id"))


@query(with_sql("messages", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS place, role, text FROM messages"))
def conversation_detail(spark, sf_dir):
    """Messages by time (two turns share a stamp), the user's before others."""
    order = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), F.when(F.col("role") == "user", 0).otherwise(1), "turn")
    return X.messages(spark, sf_dir).select("conv_id", F.row_number().over(order).cast("long").alias("place"), "role", "text")


@query(with_sql("docs", "SELECT project_id, min(document_id) AS created FROM docs GROUP BY project_id ORDER BY created DESC"))
def project_list(spark, sf_dir):
    return X.docs(spark, sf_dir).groupBy("project_id").agg(F.min("document_id").alias("created")).orderBy(F.desc("created"))


@query(with_sql("messages", "SELECT conv_id, nullif(left(trim(arg_min(text, turn)), 120), '') AS title FROM messages WHERE role = 'user' GROUP BY conv_id"))
def conversation_titles(spark, sf_dir):
    t = X.messages(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return t.select("conv_id", F.nullif(F.substring(F.trim("t"), 1, P.TITLE_CHARS), F.lit("")).alias("title"))


@query(with_sql("messages", "SELECT model, round(avg(CASE WHEN turn % 3 = 0 THEN -1 ELSE 1 END), 6) AS score, count(*) AS n FROM messages WHERE role = 'assistant' GROUP BY model"))
def feedback_summary(spark, sf_dir):
    score = F.when(F.col("turn") % 3 == 0, -1).otherwise(1)
    return X.messages(spark, sf_dir).where("role = 'assistant'").groupBy("model").agg(F.round(F.avg(score), 6).alias("score"), F.count(F.lit(1)).alias("n"))

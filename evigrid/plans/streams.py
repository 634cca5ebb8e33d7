"""Streaming forms, run over the same rows as their batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid import params as P, streaming as S
from evigrid.plans import query
from evigrid.plans.eventlog import _GEN, gen_events
from evigrid.session import shared_dir, stored
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql
from evigrid.streaming import stateful


def _streamed(spark, df, form, files=4, mode="complete"):
    """Write the rows as a few files and read them one file a trigger."""
    base = shared_dir(spark)
    df.repartition(files).write.parquet(f"{base}/in")
    return S.run_to_end(form(S.read(spark, f"{base}/in", df.schema)), base, mode)


@query(with_sql("requests", "SELECT client, sec // 86400 * 86400 AS start, count(*) AS n FROM (SELECT client, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM requests) GROUP BY ALL"))
def stream_window_counts(spark, sf_dir):
    return _streamed(spark, X.requests(spark, sf_dir).select("client", "ts"), lambda s: S.window_counts(s, 86_400))


@query(with_sql("requests", "SELECT CAST(ts AS DATE) AS day, round(sum(cost), 4) AS spent FROM requests WHERE cost > 0 GROUP BY 1"))
def stream_daily_spend(spark, sf_dir):
    return _streamed(spark, X.requests(spark, sf_dir).select("cost", "ts"), S.daily_spend)


@query(with_sql("status_log", "SELECT document_id, arg_max(status, seq) AS status FROM status_log GROUP BY document_id"))
def stream_current_status(spark, sf_dir):
    return _streamed(spark, X.status_log(spark, sf_dir).select("document_id", "seq", "status"), S.current_status)


@query(with_sql("", "SELECT * FROM fold", **_GEN))
def stream_fold_events(spark, sf_dir):
    return _streamed(spark, gen_events(spark, sf_dir).drop("ts"), S.fold_events)


@query(with_sql("requests", "SELECT client, sec // 86400 * 86400 AS start, count(*) AS n, least(count(*), 3) AS allowed FROM (SELECT client, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM requests) GROUP BY 1, 2"))
def stream_rate_decisions(spark, sf_dir):
    """A decision for each request as it comes; what does not depend on the order of arrival is counted."""
    rows = _streamed(spark, X.requests(spark, sf_dir).select("client", "event_id", "ts"), lambda s: S.rate_decisions(s, 3, 86_400), mode="append")
    return rows.groupBy("client", "start").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("allowed"))


@query(with_sql("doc_upload", "SELECT DISTINCT project_id, sha256(content) AS file_sha256 FROM doc_upload"))
def stream_dedup_upload(spark, sf_dir):
    """One upload of each project and hash; stamps lie within one day, so the watermark keeps all of them in state."""
    stamp = F.timestamp_seconds(1_700_000_000 + F.col("document_id") % 86_400)
    rows = X.doc_upload(spark, sf_dir).select("project_id", F.sha2("content", 256).alias("file_sha256"), stamp.alias("ts"))
    return _streamed(spark, rows, S.dedup_upload, mode="append").select("project_id", "file_sha256")


def _in_order(spark, rows, form, parts=4):
    """Rows in files by ranges of time, read one file a trigger in that order; the last one's rows end a day after all others."""
    base, rows = shared_dir(spark), stored(rows)  # read five times below
    cuts = rows.select(F.expr("percentile_approx(unix_seconds(cast(ts as timestamp)), array(0.25, 0.5, 0.75))")).first()[0] or []
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows.where(F.lit(True) if lo is None else at >= lo).where(F.lit(True) if hi is None else at < hi)
        part.coalesce(parts).write.mode("append").parquet(f"{base}/in")
    with stateful.rocks(spark):
        return S.run_to_end(form(S.read(spark, f"{base}/in", rows.schema, parts)), base, "append")


_STUCK = f"""SELECT document_id, seq, 'failed' AS status, 'STUCK_TIMEOUT' AS error_code, epoch_us(ts) // 1000 AS started_ms FROM (SELECT *, lead(ts) OVER (PARTITION BY document_id ORDER BY seq) AS next, (SELECT max(ts) FROM status_log) AS last FROM status_log)
    WHERE status = 'processing' AND coalesce(epoch_us(next) // 1000 - epoch_us(ts) // 1000 > {P.STUCK_MINUTES * 60_000}, epoch_us(last) // 1000 - 3600000 > epoch_us(ts) // 1000 + {P.STUCK_MINUTES * 60_000})"""


@query(with_sql("status_log", _STUCK))
def stream_stuck_documents(spark, sf_dir):
    """Each step of processing that went on past the limit, by the document's next row or by a timer on event time."""
    return _in_order(spark, X.status_log(spark, sf_dir), stateful.stuck_documents)


@query(with_sql("", "SELECT f.* FROM fold f JOIN (SELECT stream_id, max(ts) AS t, bool_or(type = 'finish') AS done FROM ge GROUP BY stream_id) USING (stream_id) WHERE epoch_us(t) // 1000 + CASE WHEN done THEN 1 ELSE 3600000 END <= (SELECT max(epoch_us(ts) // 1000) FROM ge) - 3600000", **_GEN))
def stream_closed_folds(spark, sf_dir):
    """Folded parts of each answer stream whose end the watermark has passed; its state is gone then."""
    return _in_order(spark, gen_events(spark, sf_dir), stateful.folded_streams)

"""Event logs, limits, cost and message history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evigrid import params as P
from evigrid.functions import text as T
from evigrid.operators import eventlog as E
from evigrid.plans import query
from evigrid.session import table
from evigrid.sources import fixtures as X
from evigrid.sources.fixtures import with_sql

#: The frames of an answer stream, derived from events: a stream is a user, an event's place says its type.
_TYPES = ["start", "status", "citation", "citation", "text-start", "text-delta", "text-delta", "text-end", "citation", "finish"]


def gen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), seq.alias("s"), "ts", "value")
    stream, at = F.concat("u", F.lit("-"), F.floor((F.col("s") - 1) / 10).cast("string")), (F.col("s") - 1) % 10
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (at + 1).cast("int"))
    kind = F.when((F.col("u") % 9 == 0) & (at == 8), "notice").otherwise(kind)
    ident = F.when(kind == "citation", F.concat(F.lit("cit-C"), F.when(at == 3, "2").otherwise("1")))
    cited = F.when(at == 6, F.when(F.col("u") % 7 == 0, "[C9] ").otherwise("[C1] ")).otherwise("")
    payload = F.when(kind == "text-delta", F.concat(F.lit("w"), at.cast("string"), F.lit(" "), cited)).when(kind == "citation", F.when(at == 8, "grounded").otherwise("pending"))
    return rows.select(stream.alias("stream_id"), at.alias("seq"), "ts", kind.alias("type"), ident.alias("id"), payload.alias("payload"))


_GEN = dict(
    g0="SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s, ts FROM events",
    g1=f"SELECT u, CAST(u AS VARCHAR) || '-' || CAST(s // 10 AS VARCHAR) AS stream_id, s % 10 AS seq, ts, CASE WHEN u % 9 = 0 AND s % 10 = 8 THEN 'notice' ELSE {_TYPES}[CAST(s % 10 + 1 AS INT)] END AS type FROM g0",
    ge="SELECT *, CASE WHEN type = 'citation' THEN 'cit-C' || CASE WHEN seq = 3 THEN '2' ELSE '1' END END AS id, CASE WHEN type = 'text-delta' THEN 'w' || CAST(seq AS VARCHAR) || ' ' || CASE WHEN seq <> 6 THEN '' WHEN u % 7 = 0 THEN '[C9] ' ELSE '[C1] ' END WHEN type = 'citation' THEN CASE WHEN seq = 8 THEN 'grounded' ELSE 'pending' END END AS payload FROM g1",
    fold="SELECT stream_id, type, id, arg_max(payload, seq) AS payload, min(seq) AS pos FROM ge WHERE id IS NOT NULL GROUP BY stream_id, type, id",
)


@query(with_sql("", "SELECT * FROM fold", **_GEN))
def fold_events(spark, sf_dir):
    return E.fold_events(gen_events(spark, sf_dir))


@query(with_sql("", "SELECT s.stream_id, coalesce(string_agg(f.id || ':' || f.payload, ';' ORDER BY pos), '') AS parts, max(t) AS text FROM (SELECT stream_id, coalesce(string_agg(payload, '' ORDER BY seq) FILTER (type = 'text-delta'), '') AS t FROM ge WHERE type IN ('citation', 'text-delta') GROUP BY stream_id) s LEFT JOIN fold f USING (stream_id) GROUP BY s.stream_id", **_GEN))
def message_parts(spark, sf_dir):
    return E.message_parts(gen_events(spark, sf_dir))


_MK = P.MARKER.replace("\\s", "[ \\t]").replace("\\d", "[0-9]")
_USED = dict(
    tx="SELECT stream_id, string_agg(payload, '' ORDER BY seq) FILTER (type = 'text-delta') AS t, list(DISTINCT replace(id, 'cit-', '')) FILTER (type = 'citation') AS emitted FROM ge GROUP BY stream_id",
    us=f"SELECT stream_id, len(list_filter(flatten(list_transform(regexp_extract_all(t, '{_MK}', 1), lambda g: list_transform(string_split(g, ','), lambda x: trim(x)))), lambda m: NOT list_contains(coalesce(emitted, CAST([] AS VARCHAR[])), m))) = 0 AS fine FROM tx",
)


@query(with_sql("", """SELECT stream_id, coalesce(min(seq) = min(seq) FILTER (type = 'start'), false) AS starts, coalesce(max(seq) = max(seq) FILTER (type = 'finish'), false) AS ends, coalesce(min(seq) FILTER (type = 'citation') < min(seq) FILTER (type = 'text-start'), false) AS cites_first,
    coalesce(max(seq) FILTER (type = 'citation') > max(seq) FILTER (type = 'text-end'), false) AS reemits, count(*) FILTER (type = 'status' AND id IS NOT NULL) = 0 AS status_bare, coalesce(any_value(fine), true) AS used_emitted FROM ge LEFT JOIN us USING (stream_id) GROUP BY stream_id""", **_GEN, **_USED))
def stream_contract_checks(spark, sf_dir):
    return E.contract_checks(gen_events(spark, sf_dir))


_LATENCY = "SELECT stream_id, floor(epoch(min(ts) FILTER (type = 'text-delta')))::BIGINT - floor(epoch(min(ts) FILTER (type = 'start')))::BIGINT AS ttft_s, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS total_s, CAST(coalesce(sum(length(payload)) FILTER (type = 'text-delta'), 0) // 4 AS BIGINT) AS tokens FROM ge GROUP BY stream_id"


@query(with_sql("", _LATENCY, **_GEN))
def latency_metrics(spark, sf_dir):
    """Seconds to the first delta and in all, and the tokens of the text, by stream."""
    first = lambda t: F.unix_timestamp(F.min(F.when(F.col("type") == t, F.col("ts"))))
    return gen_events(spark, sf_dir).groupBy("stream_id").agg(
        (first("text-delta") - first("start")).alias("ttft_s"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("total_s"),
        F.floor(F.coalesce(F.sum(F.when(F.col("type") == "text-delta", F.length("payload"))), F.lit(0)) / 4).cast("long").alias("tokens"),
    )


@query(with_sql("", "SELECT round(quantile_cont(ttft_s, 0.5), 6) AS ttft_p50, round(quantile_cont(ttft_s, 0.95), 6) AS ttft_p95, round(quantile_cont(total_s, 0.5), 6) AS total_p50, round(quantile_cont(total_s, 0.95), 6) AS total_p95, CAST(sum(tokens) AS BIGINT) AS tokens FROM la", **_GEN, la=_LATENCY))
def latency_summary(spark, sf_dir):
    """Exact quantiles over all streams; partial states count distinct whole seconds, not streams."""
    q = lambda c, p: F.round(F.percentile(c, p), 6)
    return latency_metrics(spark, sf_dir).agg(q("ttft_s", 0.5).alias("ttft_p50"), q("ttft_s", 0.95).alias("ttft_p95"), q("total_s", 0.5).alias("total_p50"), q("total_s", 0.95).alias("total_p95"), F.sum("tokens").alias("tokens"))


_WIN = f"SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM requests"


@query(with_sql("requests", "SELECT event_id, client, ordinal, ordinal <= 3 AS allowed, CASE WHEN ordinal > 3 THEN f + 86400 - sec END AS retry_after FROM (SELECT *, row_number() OVER (PARTITION BY client, sec // 86400 ORDER BY ts, event_id) AS ordinal, min(sec) OVER (PARTITION BY client, sec // 86400) AS f FROM w)", w=_WIN))
def rate_limit_fixed_window(spark, sf_dir):
    """Three requests a client and day, since the events are days apart."""
    return E.fixed_window(X.requests(spark, sf_dir), 3, 86_400).select("event_id", "client", "ordinal", "allowed", "retry_after")


@query("SELECT event_id, coalesce(nullif(trim(split_part(fwd, ',', 1)), ''), nullif(peer, ''), 'unknown') AS ip FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '203.0.113.' || CAST(user_id AS VARCHAR) || ', 10.0.0.1' WHEN event_id % 3 = 1 THEN ' ' END AS fwd, CASE WHEN event_id % 5 <> 0 THEN '198.51.100.' || CAST(user_id AS VARCHAR) ELSE '' END AS peer FROM events)")
def client_ip(spark, sf_dir):
    """First hop of the forwarded header, else the peer, else unknown."""
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.concat(F.lit("203.0.113."), user, F.lit(", 10.0.0.1"))).when(k == 1, " ").alias("fwd"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("198.51.100."), user)).otherwise("").alias("peer"))
    return e.select("event_id", F.coalesce(F.nullif(F.trim(F.split_part("fwd", F.lit(","), F.lit(1))), F.lit("")), F.nullif("peer", F.lit("")), F.lit("unknown")).alias("ip"))


@query(with_sql("requests", "SELECT CAST(ts AS DATE) AS day, round(sum(cost), 4) AS spent FROM requests WHERE cost > 0 GROUP BY 1"))
def daily_spend(spark, sf_dir):
    return X.requests(spark, sf_dir).where("cost > 0").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("cost"), 4).alias("spent"))


_COST = "CASE WHEN finish_reason = 'error' THEN 0.0::DOUBLE WHEN prompt_tokens IS NULL AND completion_tokens IS NULL THEN 0.01::DOUBLE ELSE coalesce(prompt_tokens, 0) / 1000.0::DOUBLE * CASE model WHEN 'gpt-4o-mini' THEN 0.00015::DOUBLE ELSE 0.00027::DOUBLE END + coalesce(completion_tokens, 0) / 1000.0::DOUBLE * CASE model WHEN 'gpt-4o-mini' THEN 0.0006::DOUBLE ELSE 0.0011::DOUBLE END END"


@query(with_sql("messages", f"SELECT conv_id, turn, round({_COST}, 9) AS cost FROM messages"))
def estimate_cost(spark, sf_dir):
    return E.estimate_cost(X.messages(spark, sf_dir)).select("conv_id", "turn", F.round("cost", 9).alias("cost"))


@query(with_sql("requests", "SELECT event_id, before, before < 5.0 AS admitted FROM (SELECT event_id, round(coalesce(sum(greatest(cost, 0)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM requests)"))
def cost_cap_admission(spark, sf_dir):
    return E.cost_admission(X.requests(spark, sf_dir)).select("event_id", "before", "admitted")


@query(with_sql("messages", "SELECT m.conv_id, max(text) FILTER (turn = q) AS question, count(*) FILTER (turn < q) AS history FROM messages m LEFT JOIN (SELECT conv_id, max(turn) AS q FROM messages WHERE role = 'user' GROUP BY 1) USING (conv_id) GROUP BY m.conv_id"))
def split_history(spark, sf_dir):
    """The last user turn is the question, the turns before it the history."""
    m = X.messages(spark, sf_dir)
    q = m.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("q"))
    return m.join(q, "conv_id", "left").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == F.col("q"), F.col("text"))).alias("question"), F.count_if(F.col("turn") < F.col("q")).alias("history"))


def truncate(messages: DataFrame, budget: int = P.HISTORY_TOKENS) -> DataFrame:
    """The newest messages within the budget; markers go from assistant texts, empty ones cost and are dropped."""
    t = F.when(F.col("role") == "assistant", T.trim(F.regexp_replace("text", P.MARKER, ""))).otherwise(F.col("text"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("clean", t).withColumn("age", F.row_number().over(w)).where(F.col("age") <= P.HISTORY_MESSAGES)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(T.count_tokens(F.col("clean"))).over(run)
    newer = F.coalesce(F.max((F.col("clean") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("keep", (cum <= budget) | (newer == 0)).where(F.col("keep") & (F.col("clean") != ""))


@query(with_sql("messages", f"SELECT conv_id, turn, clean FROM (SELECT *, sum(greatest(1, length(clean) // 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cum, coalesce(max((clean <> '')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM c) WHERE age <= 12) WHERE (cum <= 120 OR newer = 0) AND clean <> ''", c="SELECT *, CASE WHEN role = 'assistant' THEN regexp_replace(regexp_replace(regexp_replace(text, '" + P.MARKER.replace("\\s", "[ \\t]").replace("\\d", "[0-9]") + "', '', 'g'), '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '') ELSE text END AS clean FROM messages"))
def truncate_history(spark, sf_dir):
    """With a budget of 120 tokens, so that the conversations of the table are cut."""
    return truncate(X.messages(spark, sf_dir), 120).select("conv_id", "turn", "clean")

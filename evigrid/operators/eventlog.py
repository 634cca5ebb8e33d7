"""Event streams of answers, request limits and spending; batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evigrid import params as P
from evigrid.functions import text as T


def fold_events(events: DataFrame) -> DataFrame:
    """Per (stream, id): the last payload at the place of the first; ``seq`` orders a stream."""
    return events.where("id is not null").groupBy("stream_id", "type", "id").agg(F.max_by("payload", "seq").alias("payload"), F.min("seq").alias("pos"))


def message_parts(events: DataFrame) -> DataFrame:
    """Citations, figures and tables in first-seen order, then the text of the deltas."""
    kinds = F.when(F.col("type") == "citation", 0).when(F.col("type") == "figure", 1).when(F.col("type") == "table", 2)
    media = fold_events(events.where(F.col("type").isin("citation", "figure", "table"))).select("stream_id", F.struct(kinds.alias("kind"), "pos", "id", "payload").alias("x"))
    parts = media.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["id"], x["payload"])), ";").alias("parts"))
    text = events.where("type = 'text-delta'").groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "").alias("text"))
    return parts.join(text, "stream_id", "full").select("stream_id", F.coalesce("parts", F.lit("")).alias("parts"), F.coalesce("text", F.lit("")).alias("text"))


def contract_checks(events: DataFrame) -> DataFrame:
    """One row a stream: starts, ends, a citation before the text, a second emission after it, no id on status,
    and no marker in the text without an emitted citation, figure or table (ids end in their marker)."""
    at = lambda t, f: f(F.when(F.col("type") == t, F.col("seq")))
    s = events.groupBy("stream_id").agg(
        F.min("seq").alias("lo"), F.max("seq").alias("hi"), at("start", F.min).alias("start"), at("finish", F.max).alias("finish"), at("citation", F.min).alias("c1"), at("citation", F.max).alias("c2"),
        at("text-start", F.min).alias("t1"), at("text-end", F.max).alias("t2"), F.count_if((F.col("type") == "status") & F.col("id").isNotNull()).alias("bad"),
        F.collect_set(F.when(F.col("type").isin("citation", "figure", "table"), F.substring_index("id", "-", -1))).alias("emitted"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "text-delta", F.struct("seq", "payload")))).alias("deltas"),
    )
    ok = lambda c: F.coalesce(c, F.lit(False))
    used = T.markers(F.array_join(F.transform("deltas", lambda d: d["payload"]), ""))
    return s.select("stream_id", ok(F.col("lo") == F.col("start")).alias("starts"), ok(F.col("hi") == F.col("finish")).alias("ends"), ok(F.col("c1") < F.col("t1")).alias("cites_first"), ok(F.col("c2") > F.col("t2")).alias("reemits"), (F.col("bad") == 0).alias("status_bare"), (F.size(F.array_except(used, "emitted")) == 0).alias("used_emitted"))


def fixed_window(requests: DataFrame, limit: int = P.RATE_MESSAGES, seconds: int = P.RATE_WINDOW_S) -> DataFrame:
    """Each request with its ordinal in (client, window), whether it is allowed and the wait after the first hit."""
    sec = F.unix_timestamp("ts")
    key = Window.partitionBy("client", "win")
    rows = requests.withColumn("win", F.floor(sec / seconds).cast("long"))
    n = F.row_number().over(key.orderBy("ts", "event_id")).cast("long")
    first = F.min(sec).over(key)
    return rows.withColumn("ordinal", n).withColumn("retry_after", F.when(n > limit, first + seconds - sec)).withColumn("allowed", F.col("ordinal") <= limit)


def estimate_cost(messages: DataFrame) -> DataFrame:
    """Adds ``cost``: tokens by the model's price, unknown models at the highest, a flat sum without counts; nothing for a failed answer."""
    spark = messages.sparkSession
    prices = spark.createDataFrame([(m, a, b) for m, (a, b) in P.PRICES.items()], "model string, price_in double, price_out double")
    top_in, top_out = (max(p[i] for p in P.PRICES.values()) for i in (0, 1))
    known = messages.join(F.broadcast(prices), "model", "left")  # as many rows as there are models
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)) / 1000.0
    cost = tokens("prompt_tokens") * F.coalesce("price_in", F.lit(top_in)) + tokens("completion_tokens") * F.coalesce("price_out", F.lit(top_out))
    none = F.col("prompt_tokens").isNull() & F.col("completion_tokens").isNull()
    failed = F.coalesce(F.col("finish_reason") == "error", F.lit(False)) if "finish_reason" in messages.columns else F.lit(False)
    return known.withColumn("cost", F.when(failed, 0.0).when(none, P.FLAT_COST_USD).otherwise(cost)).drop("price_in", "price_out")


#: Seconds of one slice of a day.
SLICE = 60


def cost_admission(requests: DataFrame, cap: float = P.DAILY_CAP_USD) -> DataFrame:
    """A request is blocked where the spending of its day before it has reached the cap.

    Running sums in two levels: slices of ``SLICE`` seconds are summed first, so a task
    holds one slice of a day and an offset, never the whole day.
    """
    paid = F.greatest("cost", F.lit(0.0))
    rows = requests.withColumn("day", F.to_date("ts")).withColumn("_slice", F.floor(F.unix_timestamp("ts") / SLICE).cast("long"))
    slices = rows.groupBy("day", "_slice").agg(F.sum(paid).alias("_sum"))
    earlier = Window.partitionBy("day").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = slices.select("day", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_offset"))
    order = Window.partitionBy("day", "_slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.round(F.col("_offset") + F.coalesce(F.sum(paid).over(order), F.lit(0.0)), 6)
    return rows.join(offset, ["day", "_slice"]).withColumn("before", before).withColumn("admitted", F.col("before") < cap).drop("_slice", "_offset")

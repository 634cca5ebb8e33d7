"""Keyed state: timers, restarts from a checkpoint, results of earlier epochs."""

from pyspark.sql import functions as F

from evigrid import streaming as S
from evigrid.session import shared_dir
from evigrid.streaming import stateful

LOG = "document_id long, seq long, status string, at string"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG).select("document_id", "seq", "status", F.col("at").cast("timestamp_ntz").alias("ts"))


def run(spark, base, schema):
    with stateful.rocks(spark):
        return S.run_to_end(stateful.stuck_documents(S.read(spark, f"{base}/in", schema, 10), 45, "0 seconds"), base, "append")


def test_stuck_documents_over_a_restart(spark):
    """A stop between two triggers changes nothing: state, timers and rows of earlier epochs stay."""
    first = log(spark, (1, 1, "processing", "2024-01-01 00:00:00"), (2, 1, "processing", "2024-01-01 00:00:00"), (2, 2, "text_ready", "2024-01-01 00:30:00"), (3, 1, "processing", "2024-01-01 00:20:00"))
    second = log(spark, (3, 2, "text_ready", "2024-01-01 01:30:00"), (4, 1, "processing", "2024-01-01 01:30:00"), (5, 1, "full_ready", "2024-01-01 01:31:00"))
    third = log(spark, (6, 1, "queued", "2024-01-01 06:00:00"))
    base = shared_dir(spark)
    got = []
    for part in (first, second, third):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        got.append(sorted((r.document_id, r.seq) for r in run(spark, base, first.schema).collect()))
    assert got == [[], [(1, 1), (3, 1)], [(1, 1), (3, 1), (4, 1)]]


def test_rate_decisions_of_one_hot_client(spark):
    """2,500 requests of one client in one window and trigger: places follow time."""
    rows = spark.range(2500).select(F.lit("a").alias("client"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 500).alias("ts"))
    base = shared_dir(spark)
    rows.coalesce(1).write.parquet(f"{base}/in")
    out = S.run_to_end(S.rate_decisions(S.read(spark, f"{base}/in", rows.schema), 20, 3600), base, "append")
    seen = [(r.ordinal, r.event_id * 7919 % 500) for r in out.orderBy("ordinal").collect()]
    assert [o for o, _ in seen] == list(range(1, 2501)) and [t for _, t in seen] == sorted(t for _, t in seen)


def test_stream_without_any_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "client string, event_id long, ts timestamp").schema
    out = S.run_to_end(S.window_counts(S.read(spark, str(tmp_path / "in"), schema), 600), f"file://{tmp_path}/s", "append")
    assert out.count() == 0


def test_windows_of_a_client_share_a_call(spark):
    """One group a client and trigger, not one a window; places go on over triggers, and old windows leave the state."""
    rows = spark.range(600).select((F.col("id") % 3).cast("string").alias("client"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 900).alias("ts"))
    base = shared_dir(spark)
    for lo in (0, 300):
        rows.where(f"event_id >= {lo} and event_id < {lo + 300}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    out = S.run_to_end(S.rate_decisions(S.read(spark, f"{base}/in", rows.schema), 4, 7200, late="1 hour"), base, "append").cache()
    assert out.count() == 600
    per = out.groupBy("client", "start").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("m"), F.countDistinct("ordinal").alias("d"))
    assert per.where("n <> m or n <> d").count() == 0 and out.where("allowed <> (ordinal <= 4) or (retry_after is null) <> allowed").count() == 0
    state = spark.read.format("statestore").load(f"{base}/checkpoint").selectExpr("key.*", "value.*")
    assert state.count() == 3


EVENTS = "stream_id string, seq long, type string, id string, payload string, at string"


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS).select("stream_id", "seq", "type", "id", "payload", F.col("at").cast("timestamp_ntz").alias("ts"))


def test_streams_of_a_bucket_share_a_call(spark):
    """State is one row a bucket, not a stream; parts go on over triggers, closed streams leave it, and their rows are those of the batch form."""
    from evigrid.operators.eventlog import fold_events

    one = spark.range(600).select(F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("stream_id"), F.floor(F.col("id") / 200).alias("seq"), F.lit("citation").alias("type"), F.concat(F.lit("c"), F.floor(F.col("id") / 400).cast("string")).alias("id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("payload"), F.timestamp_seconds(1_700_000_000 + F.col("id")).cast("timestamp_ntz").alias("ts"))
    base = shared_dir(spark)
    for lo in (0, 300):
        one.where(f"seq * 200 + cast(substr(stream_id, 2) as int) between {lo} and {lo + 299}").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        with stateful.rocks(spark):
            return S.run_to_end(stateful.folded_streams(S.read(spark, f"{base}/in", one.schema), "1 hour", buckets=8), base, "append")

    assert run().count() == 0
    state = spark.read.format("statestore").load(f"{base}/checkpoint").selectExpr("key.bucket", "value.*")
    assert state.count() == 8
    last = events(spark, ("end", 0, "start", None, None, "2024-06-01 00:00:00"))
    last.coalesce(1).write.mode("append").parquet(f"{base}/in")
    rows = lambda df: sorted(map(tuple, df.select("stream_id", "type", "id", "payload", "pos").collect()), key=repr)
    assert rows(run()) == rows(fold_events(one)) != []
    state = spark.read.format("statestore").load(f"{base}/checkpoint").selectExpr("key.bucket", "value.*")
    assert state.count() == 1  # the bucket of the stream that is open


def test_finish_of_an_earlier_trigger_counts(spark):
    """A stream that finished closes with its last row, also where that row comes a trigger later; one of no name is a stream as well."""
    a = events(spark, ("a", 9, "finish", None, None, "2024-01-01 00:00:00"), (None, 9, "finish", None, None, "2024-01-01 00:00:00"))
    b = events(spark, ("a", 3, "citation", "x", "late", "2024-01-01 00:00:10"), ("b", 3, "citation", "y", "open", "2024-01-01 00:00:10"), (None, 3, "citation", "z", None, "2024-01-01 00:00:10"))
    c = events(spark, ("c", 0, "start", None, None, "2024-01-01 00:30:00"))
    base = shared_dir(spark)
    for part in (a, b, c):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    with stateful.rocks(spark):
        out = S.run_to_end(stateful.folded_streams(S.read(spark, f"{base}/in", a.schema), "1 minute"), base, "append")
    assert sorted(map(tuple, out.collect()), key=repr) == [("a", "citation", "x", "late", 3), (None, "citation", "z", None, 3)]


def test_timers_fire_when_the_watermark_reaches_them(spark):
    """A step is stuck from the millisecond on in which the watermark passes its limit, in one bucket as in many."""
    rows = log(spark, (1, 1, "processing", "2024-01-01 00:00:00"), (2, 1, "processing", "2024-01-01 00:00:00.001"), (3, 1, "full_ready", "2024-01-01 00:45:00.001"))
    for buckets in (1, 64):
        base = shared_dir(spark)
        rows.coalesce(1).write.parquet(f"{base}/in")
        with stateful.rocks(spark):
            out = S.run_to_end(stateful.stuck_documents(S.read(spark, f"{base}/in", rows.schema), 45, "0 seconds", buckets), base, "append")
        assert [(r.document_id, r.seq, r.started_ms) for r in out.collect()] == [(1, 1, 1704067200000)]

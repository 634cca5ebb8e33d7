"""Keyed state with event-time timers: stuck documents and folded answer streams, each key's state ends.

Keys are held by buckets of their hash: one call takes all rows of a bucket in a trigger with all that the
bucket's keys keep, so work is that of the rows, where a call and its messages a key cost milliseconds each.
The number of buckets belongs to a checkpoint, as that of its partitions does; what a bucket keeps is its share
of the open keys.  State lives in RocksDB and is restored from the checkpoint; ``rocks`` sets the provider for a
query's start.  Rows that come later than the watermark allows are dropped by Spark before they reach a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from evigrid import params as P
from evigrid.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long the state of a document that came to an end is kept for late rows, and of a stream that never ends.
KEPT_MS, OPEN_MS = 24 * 3_600_000, 60 * 60_000
DONE = ("full_ready", "rejected", "deleted")
BUCKETS = 512


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Within it queries start on RocksDB; the setting before it comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _lists(frame: pd.DataFrame) -> list[list]:
    """Columns as lists of plain values, missing ones as None."""
    return [[x if x == x else None for x in frame[c].tolist()] for c in frame.columns]


def _by_buckets(rows: DataFrame, key: str, step: Callable, out: str, kept: str, buckets: int) -> DataFrame:
    """``step`` once a bucket and trigger.

    step(held, new, watermark) takes the columns ``kept`` of what it kept (None at first) and the trigger's rows (None
    where only a timer is over), and gives the rows that are over, the columns to keep and the ms of the earliest
    timer among them, None without any.
    """
    ship(rows.sparkSession)

    def run(_, frames, state):
        watermark = int(state.getCurrentWatermarkMs())
        new = None if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        over, held, due = step(state.get if state.exists else None, new, watermark)
        if due is None:
            state.remove()
        else:
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(due - 1, watermark, 1))  # a timer fires when the watermark is past it
        if len(over):
            yield over

    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


STUCK = "document_id {kind}, seq long, status string, error_code string, started_ms long"


def _stuck(limit: int) -> Callable:
    """(document_id, seq, status, ms) -> the steps of processing that went on for more than the limit (ms).

    A step is stuck by the next row of its document or, without one, by a timer on event time.
    """
    names = ["document_id", "seq", "status", "ms"]

    def step(held, new, watermark: int):
        last = None if held is None else pd.DataFrame(dict(zip(names, held)))
        over = []
        if new is not None:
            new = new[names].sort_values("seq", kind="stable")
            rows = (new if last is None else pd.concat([last, new], ignore_index=True)).sort_values("document_id", kind="stable", ignore_index=True)
            same = rows["document_id"].eq(rows["document_id"].shift(-1)) | (rows["document_id"].isna() & rows["document_id"].shift(-1, fill_value="").isna())
            over.append(rows[same & (rows["status"] == "processing") & (rows["ms"].shift(-1) - rows["ms"] > limit)])
            last = rows[~same]
        due = last["ms"] + np.where(last["status"] == "processing", limit, KEPT_MS) + 1
        passed = due <= watermark
        over.append(last[passed & (last["status"] == "processing")])
        found = pd.concat(over).rename(columns={"ms": "started_ms"}).assign(status="failed", error_code="STUCK_TIMEOUT")
        return found, _lists(last[~passed]), None if passed.all() else int(due[~passed].min())

    return step


def stuck_documents(log: DataFrame, minutes: int = P.STUCK_MINUTES, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(document_id, seq, status, error_code, started_ms) of each stuck step of a log (document_id, seq, status, ts)."""
    kind = log.schema["document_id"].dataType.simpleString()
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("document_id", F.col("seq").cast("long").alias("seq"), "status", F.unix_millis("ts").alias("ms"), "ts")
    kept = f"documents array<{kind}>, seqs array<long>, statuses array<string>, ms array<long>"
    return _by_buckets(rows, "document_id", _stuck(minutes * 60_000), STUCK.format(kind=kind), kept, buckets)


FOLDED = "stream_id string, type string, id string, payload string, pos long"
_OPEN = "streams array<string>, ends array<long>, dones array<boolean>"
_PARTS = "owners array<string>, types array<string>, ids array<string>, payloads array<string>, seqs array<long>, places array<long>"


def _folded(held, new, watermark: int):
    """Events of streams -> the folded parts of a stream once it finishes, or once its time is over; then its state goes.

    Rows of one trigger may come before earlier ones of the next, so a finished stream is told by its timer too.
    """
    ends, parts, part = ["stream_id", "end", "done"], ["stream_id", "type", "id", "payload", "seq", "pos"], ["stream_id", "type", "id"]
    streams, rows = [], []
    if held is not None:
        streams.append(pd.DataFrame(dict(zip(ends, held[:3]))))
        rows.append(pd.DataFrame(dict(zip(parts, held[3:]))))
    if new is not None:
        streams.append(new.assign(end=new["ms"], done=new["type"] == "finish")[ends])
        rows.append(new.assign(pos=new["seq"])[new["id"].notna()][parts])
    streams = [x for x in streams if len(x)]
    open_ = pd.concat(streams, ignore_index=True).groupby("stream_id", sort=False, dropna=False, as_index=False).agg({"end": "max", "done": "any"})
    rows = pd.concat([x for x in rows if len(x)] or rows[:1], ignore_index=True)
    if len(rows):
        rows["pos"] = rows.groupby(part, sort=False, dropna=False)["pos"].transform("min")
        rows = rows.sort_values("seq", kind="stable").drop_duplicates(part, keep="last")
    due = open_["end"] + np.where(open_["done"], 1, OPEN_MS)
    over = due <= watermark
    ended = open_["stream_id"][over]
    gone = rows["stream_id"].isin(ended) | (rows["stream_id"].isna() & ended.isna().any())
    return rows[gone][[*part, "payload", "pos"]], [*_lists(open_[~over]), *_lists(rows[~gone])], None if over.all() else int(due[~over].min())


def folded_streams(events: DataFrame, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(stream_id, type, id, payload, pos): the last payload and first place of each part, when the watermark has passed the stream's end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "type", "id", "payload", F.unix_millis("ts").alias("ms"), "ts")
    return _by_buckets(rows, "stream_id", _folded, FOLDED, f"{_OPEN}, {_PARTS}", buckets)

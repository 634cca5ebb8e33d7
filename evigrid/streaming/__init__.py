"""Structured Streaming forms of the event-log operators.

In append and update mode state is bounded by the watermark: what is older than ``LATE``
is dropped, and late rows beyond it are not counted.  Complete mode, which the
registered queries use to compare whole results, keeps all groups.  Each form gives the batch operator's
rows on the same input once the stream has ended.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

LATE = "40 days"


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(requests: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """Requests per client and fixed window; a client over its limit is one whose count passes it."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("client", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("client", F.unix_timestamp("w.start").alias("start"), "n")


def rate_decisions(requests: DataFrame, limit: int, seconds: int, late: str = LATE) -> DataFrame:
    """Each request (client, event_id, ts) with its ordinal in (client, window), allowed or not, and the wait.

    State is a client's open windows, each with its count and first second; a window goes once the
    watermark has passed its end, and one call takes all of a client's requests of a trigger.  Requests of one trigger are taken in order of time, those of
    later triggers after them, so places can differ from the batch form, numbers allowed never.
    """
    kind = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("sec", F.unix_timestamp("ts"))
    keyed = timed.select("client", (F.floor(F.col("sec") / seconds) * seconds).cast("long").alias("start"), "event_id", "sec", "ts")

    def decide(key, frames, state):
        watermark = int(state.getCurrentWatermarkMs())
        held = {w: (n, first) for w, n, first in zip(*state.get)} if state.exists else {}  # window -> count and first second
        if not state.hasTimedOut:
            f = pd.concat(list(frames), ignore_index=True).sort_values(["start", "sec", "event_id"], ignore_index=True)
            sec = f["sec"].to_numpy()
            windows, at, size = np.unique(f["start"].to_numpy(), return_index=True, return_counts=True)
            known = [held.get(int(w), (0, int(sec[i]))) for w, i in zip(windows, at)]
            place = np.arange(1, len(f) + 1) + np.repeat(np.array([n for n, _ in known], np.int64) - at, size)
            wait = pd.array(np.repeat(np.array([first for _, first in known], np.int64), size) + seconds - sec, "Int64")
            wait[place <= limit] = pd.NA
            held |= {int(w): (n + int(k), first) for w, k, (n, first) in zip(windows, size, known)}
            yield pd.DataFrame({"client": f["client"], "start": f["start"], "event_id": f["event_id"], "ordinal": place, "allowed": place <= limit, "retry_after": wait})
        held = {w: x for w, x in held.items() if (w + seconds) * 1000 > watermark}
        if held:
            state.update((list(held), [n for n, _ in held.values()], [first for _, first in held.values()]))
            state.setTimeoutTimestamp(max((min(held) + seconds) * 1000, watermark + 1))
        else:
            state.remove()

    out = f"client {kind['client']}, start long, event_id {kind['event_id']}, ordinal long, allowed boolean, retry_after long"
    return keyed.groupBy("client").applyInPandasWithState(decide, out, "starts array<long>, ns array<long>, firsts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def daily_spend(requests: DataFrame, late: str = LATE) -> DataFrame:
    timed = requests.where("cost > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w")).agg(F.round(F.sum("cost"), 4).alias("spent")).select(F.to_date("w.start").alias("day"), "spent")


def current_status(log: DataFrame) -> DataFrame:
    """The latest status of each document; state is one row a document."""
    return log.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))


def fold_events(events: DataFrame) -> DataFrame:
    """Last payload and first place of each (stream, type, id)."""
    return events.where("id is not null").groupBy("stream_id", "type", "id").agg(F.max_by("payload", "seq").alias("payload"), F.min("seq").alias("pos"))


def dedup_upload(uploads: DataFrame, late: str = LATE) -> DataFrame:
    """The first upload of each project and hash within the watermark."""
    return uploads.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["project_id", "file_sha256"])


def run_to_end(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Process all that is there and return the sink's content, for tests and backfills.

    ``foreachBatch`` writes each batch to its own folder, so a batch that runs again after a failure
    overwrites itself; rows of epochs before a restart are read with the others.  Complete mode gives the
    last epoch, other modes all of them; a stream without any batch gives no rows.
    """
    spark, schema = stream.sparkSession, stream.schema

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/epoch=-1")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields]).add("epoch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        rows = rows.where(F.col("epoch") == (rows.agg(F.max("epoch")).first()[0] or 0))
    return rows.drop("epoch")

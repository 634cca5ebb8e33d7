"""Shards by extendible hashing (operator 9), in DataFrame operations alone.

The directory is indexed by the leading bits of a 60-bit hash of the key.  All
buckets start at depth 0; a bucket over the byte limit splits on the next bit,
and only such buckets do, until each fits.  Bytes are summed per bucket before
anything moves, so a level costs one aggregation with partial sums over the rows
whose bucket is still open.  The first level sums as many bits as there will be shards,
and ``SPARE`` more, so its sums grow with the number of shards; what is open then is
taken ``STRIDE`` bits at a time.

A bucket that cannot split, because its rows share one hash (one row over the
limit, or an id repeated), gets overflow pages: its rows are dealt to strands of about
``STRAND_PAGES`` pages each, so a hot id is no task of its own, and a strand closes
a page at the limit; a single row over the limit has a page alone.

``write`` sends each document once to its shard: it meets the directory by the
bits of its hash, and only rows on overflow pages are stored and numbered before.

Results for odd input: null keys hash like an empty text; null texts have 0
bytes; very long texts count whole; repeated rows each have their place; an empty table
gives no shards; other columns are written whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evigrid.session import stored

BITS, SPARE, STRIDE, STRAND_PAGES = 60, 3, 8, 64
#: A level of the directory with at most so many rows (some 40 bytes each) is broadcast, after a count; larger ones are joined by exchange.
BROADCAST_ROWS = 500_000


def key_hash(key: str) -> Column:
    """The first 60 bits of the md5 of the key's text, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth) -> Column:
    return F.expr(f"shiftright(hash, {BITS} - ({depth}))")


def _measures(key: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), key_hash(key).alias("hash")


def directory(rows: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """From (hash, bytes): for each stride its last bit and (fine, depth, bucket, shard_bytes), and (hash, total) of what cannot split."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    levels, open_rows, top = [], rows.select("hash", "bytes"), 0
    while top < BITS:
        low, top = top, min(BITS, top + STRIDE if levels else SPARE + max(total // limit, 1).bit_length())
        # one sum for the finest prefixes of this stride, the coarser ones from those
        fine = stored(open_rows.groupBy(_prefix(top).alias("fine")).agg(F.sum("bytes").alias("bytes")))
        each = fine.select("fine", "bytes", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("depth"))
        bucket = F.expr(f"shiftright(fine, {top} - depth)")
        sums = each.groupBy("depth", bucket.alias("bucket")).agg(F.sum("bytes").alias("shard_bytes"))
        # a bucket is a shard at the least depth at which it fits
        fit = each.select("fine", "depth", bucket.alias("bucket")).join(sums.where(F.col("shard_bytes") <= limit), ["depth", "bucket"])
        level = stored(fit.groupBy("fine").agg(F.min(F.struct("depth", "bucket", "shard_bytes")).alias("s")).select("fine", "s.*"))
        levels.append((top, level))
        left = fine.join(level, "fine", "left_anti").select("fine")
        if left.isEmpty():
            return levels, rows.where("false").select("hash", F.col("bytes").alias("total"))
        open_rows = open_rows.join(left, _prefix(top) == left["fine"], "left_semi")
    return levels, stored(open_rows.groupBy("hash").agg(F.sum("bytes").alias("total")))


def _placed(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows with a hash, and the shard of each (null where its rows cannot split): depth, bucket, shard_bytes."""
    out, names = rows, ("depth", "bucket", "shard_bytes")
    for top, level in levels:
        found = level.select(F.col("fine").alias(f"_fine{top}"), *(F.col(c).alias(f"_{c}{top}") for c in names))
        found = F.broadcast(found) if level.count() <= BROADCAST_ROWS else found
        out = out.join(found, _prefix(top) == F.col(f"_fine{top}"), "left")
    return out.select(*rows.columns, *(F.coalesce(*(F.col(f"_{c}{top}") for top, _ in levels)).alias(f"_{c}") for c in names))


def _pages(rows: DataFrame, total: DataFrame, limit: int) -> DataFrame:
    """(row, hash, bytes) of rows that cannot split -> page and the bytes on it as well."""
    strands = F.ceil(F.col("total") / (limit * STRAND_PAGES)).cast("int")
    dealt = rows.join(total, "hash").withColumn("strand", F.pmod(F.xxhash64("row"), F.greatest(strands, F.lit(1))).cast("long"))
    small = F.col("bytes") * 2 <= limit  # pages of small rows close past half the limit; a larger row is a page alone
    order = Window.partitionBy("hash", "strand", small).orderBy("bytes", "row")
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    page = F.when(small, 2 * F.floor(before / (limit / 2))).otherwise(2 * F.row_number().over(order) - 1).cast("long")
    paged = stored(dealt.select("row", "hash", "bytes", (F.col("strand") * (1 << 32) + page).alias("page")))
    return paged.join(paged.groupBy("hash", "page").agg(F.sum("bytes").alias("shard_bytes")), ["hash", "page"])


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, depth, bucket (the prefix as a number), page, shard_bytes of each row."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), *_measures(key, text)))
    levels, total = directory(rows, limit)
    placed = _placed(rows, levels)
    done = placed.where("_bucket is not null").select("key", "bytes", F.col("_depth").cast("int").alias("depth"), F.col("_bucket").alias("bucket"), F.lit(0).cast("long").alias("page"), F.col("_shard_bytes").alias("shard_bytes"))
    if total.isEmpty():
        return done
    paged = _pages(rows.join(total.select("hash"), "hash", "left_semi").select("row", "hash", "bytes"), total, limit).join(rows.select("row", "key"), "row")
    return done.unionByName(paged.select("key", "bytes", F.lit(BITS).alias("depth"), F.col("hash").alias("bucket"), "page", "shard_bytes"))


def write(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as one folder a shard.

    A row reaches its shard by one exchange; a shard is at most ``limit`` bytes of text,
    or one row over that, so a task holds no more than a few shards.
    """
    body = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), *_measures(key, text))
    levels, total = directory(stored(docs.select(*_measures(key, text))), limit)
    shard = lambda *parts: F.concat_ws("-", F.lit("s"), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)).alias("_shard")
    placed = _placed(body, levels).where("_bucket is not null").select("_doc", shard("_depth", "_bucket", F.lit("0")))
    if not total.isEmpty():  # rows with one hash: numbered in a stored copy, paged by narrow rows
        over = stored(body.join(total.select("hash"), "hash", "left_semi").select(F.monotonically_increasing_id().alias("row"), "hash", "bytes", "_doc"))
        paged = _pages(over.select("row", "hash", "bytes"), total, limit)
        placed = placed.unionByName(over.select("row", "_doc").join(paged, "row").select("_doc", shard(F.lit(str(BITS)), "hash", "page")))
    placed.repartition(F.col("_shard")).write.partitionBy("_shard").parquet(path)


def read(spark: SparkSession, path: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, depth, bucket, page, shard_bytes as the shards under ``path`` hold them; ``docs`` gives the columns."""
    schema = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), F.lit("").alias("_shard")).schema
    part = F.split("_shard", "-")
    rows = spark.read.schema(schema).parquet(path).select(F.col("_doc")[key].alias("key"), F.coalesce(F.octet_length(F.col("_doc")[text]), F.lit(0)).cast("long").alias("bytes"), "_shard")
    sums = rows.groupBy("_shard").agg(F.sum("bytes").alias("shard_bytes"))
    return rows.join(sums, "_shard").select("key", "bytes", part[1].cast("int").alias("depth"), part[2].cast("long").alias("bucket"), part[3].cast("long").alias("page"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as one folder a shard and return the directory: depth, bucket, page, rows, bytes."""
    write(docs, path, limit, key, text)
    return read(docs.sparkSession, path, docs, key, text).groupBy("depth", "bucket", "page").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))

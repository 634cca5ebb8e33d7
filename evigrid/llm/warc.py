"""WARC archives: records, and transactions put together again (operator 4).

``records`` makes a request, a response (or revisit) and a metadata record of each
page; request and metadata name the response in WARC-Concurrent-To.  Of pages with
equal payloads of at least ``least`` bytes the one with the largest key is the
response and the others are revisits that refer to it; the metadata of a revisit
names the page it refers to as well.

``write`` packs records up to ``PACK_BYTES`` and puts the packs out as WARC/1.1 files,
compressed by file, through Spark's text writer, whose line end closes a pack's last record;
so archives go to any store that Spark writes to, and a file holds one pack whatever
the sizes of pages.  ``read`` takes any WARC files (plain, or gzip by record or by
file), cuts records by their Content-Length and never by their contents, and
measures payloads where it parses them.  ``captures`` joins the records of a transaction
through the concurrent-to identifiers and gives one nested row per capture.

Each archive is parsed once, as a stream of one binary row; what a task holds is
one file.  With ``blocks=False`` no payload leaves the parser, so only headers and
measures are dealt by transaction.

Results for odd input: null payloads are empty ones; empty payloads are equal to each
other; null keys are responses; rows equal in key, url and payload are one capture with
that many ``copies``, and ``page_rows`` gives each again; rows with one key and different
payloads are captures of their own; of several requests or metadata records of one
response the least record id stays; captures without them have null structs; where an
archive breaks off or a record has no valid length, the rest of the file is one record
of the kind ``broken``; very long payloads have files of their own; other columns of the
pages are ignored whatever their names; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evigrid.session import ship

#: The alphabet of base32, record end, profile of a revisit.
BASE32, END = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACK_BYTES, DATE = 32 << 20, "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, kind string, target_uri string, concurrent_to string, refers_to string, payload_digest string, headers map<string,string>, "
    "fields map<string,string>, http_length long, payload_bytes long, payload_sha1 string, block_bytes long, block binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from 5 hexadecimal digits (4 signs) at a time."""
    digest = F.sha1(payload.cast("binary"))
    return F.element_at(F.transform(F.array(digest), lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: _four(d, i)), "")), 1)


def _four(digest: Column, i: Column) -> Column:
    n = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))


def _urn(role: str, *of: Column) -> Column:
    """A record id that is the same in every run: a name-based identifier."""
    h = F.md5(F.concat_ws("\x1f", F.lit(role), *(F.coalesce(x.cast("string"), F.lit("\x1e")) for x in of)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, fields: list, block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    for name, value in [*fields, ("WARC-Date", F.lit(DATE)), ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)))  # concat_ws leaves null lines out
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block, F.lit("\r\n"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """One row per record: value, without the line end that closes it.

    Equal payloads meet as (digest, size) with partial maxima before the exchange,
    so thousands of copies of one page move as one row a task.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    base = pages.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "").alias("url"), body.alias("body"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    last = base.groupBy("digest", "size").agg(F.max(F.struct("key", "url")).alias("last"))
    rows = base.join(last, ["digest", "size"]).withColumn("again", F.coalesce((F.col("key") < F.col("last.key")) & (F.col("size") >= least), F.lit(False)))
    again, is_response = F.col("again"), ~F.col("again")
    uri = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("http://host.invalid/"), F.regexp_replace("url", "^/", "")))
    path, host = F.regexp_replace(uri, "^https?://[^/]*", ""), F.regexp_extract(uri, "^https?://([^/]*)", 1)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    name = (F.col("key"), F.col("url"), F.col("digest"))
    response, target = _urn("response", *name), ("WARC-Target-URI", uri)
    main = _record(
        F.when(again, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", response), target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(again, _urn("response", F.col("last.key"), F.col("last.url"), F.col("digest")))), ("WARC-Profile", F.when(again, PROFILE)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(head, F.when(is_response, F.col("body")).otherwise("")),
    )
    request = _record(
        "request",
        [("WARC-Record-ID", _urn("request", *name)), target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    number = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    meta = _record(
        "metadata",
        [("WARC-Record-ID", _urn("metadata", *name)), target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(number("pageId", F.col("key")), number("refersToPageId", F.when(again, F.col("last.key")))),
    )
    return rows.select(F.explode(F.array(request, main, meta)).alias("value"))


def write(pages: DataFrame, path: str, **names) -> None:
    """Archives under ``path``; an empty table writes none but the folder."""
    ship(pages.sparkSession)
    limit = PACK_BYTES

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array(["\r\n".join(held)])], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\r\n".join(held)])], names=["value"])

    packs = records(pages, **names).mapInArrow(pack, "value string")
    packs.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def parse(data: bytes):
    """(headers, block) of each record of one archive, plain or gzip."""
    if data[:2] == b"\x1f\x8b":
        out, whole = [], True
        while data and whole:
            d = zlib.decompressobj(31)
            try:
                out.append(d.decompress(data) + d.flush())
            except zlib.error:
                break
            data, whole = d.unused_data.lstrip(b"\0"), d.eof
        data = b"".join(out)
    at, end = 0, len(data)
    while at < end:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= end:
            return
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : max(stop, at)].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        start = stop + 4
        if stop < 0 or not lines[0].startswith("WARC/") or not (size.isascii() and size.isdigit()) or start + int(size) > end:
            yield {"warc-type": "broken"}, data[at:]
            return
        at = start + int(size)
        yield headers, data[start:at]


def _fields(block: bytes) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]


def _row(h: dict, block: bytes, blocks: bool) -> dict:
    """A record with the measures of its payload; of a revisit the length that its HTTP header states."""
    bare = lambda x: x.strip("<>") if x else None
    kind, stated, body = h.get("warc-type"), None, block
    if h.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        found = dict((k.lower(), v) for k, v in _fields(head)).get("content-length", "")
        stated = int(found) if found.isascii() and found.isdigit() and len(found) < 19 else None
    return {
        "record_id": bare(h.get("warc-record-id")), "kind": kind, "target_uri": h.get("warc-target-uri"), "concurrent_to": bare(h.get("warc-concurrent-to")),
        "refers_to": bare(h.get("warc-refers-to")), "payload_digest": h.get("warc-payload-digest"), "headers": list(h.items()),
        "fields": _fields(block) if h.get("content-type") == "application/warc-fields" else [], "http_length": stated,
        "payload_bytes": len(body), "payload_sha1": base64.b32encode(hashlib.sha1(body).digest()).decode(), "block_bytes": len(block), "block": block if blocks else None,
    }


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``; without ``blocks`` their contents are measured and let go."""
    ship(spark)

    def run(batches):
        for b in batches:
            for x in b.column(0):
                rows, size = [], 0
                for h, block in parse(x.as_py()):
                    rows.append(_row(h, block, blocks))
                    size += len(block) if blocks else 0
                    if len(rows) == 500 or size > PACK_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "kind", "target_uri", "concurrent_to", "refers_to", "payload_digest")]
    + [(n, pa.map_(pa.string(), pa.string())) for n in ("headers", "fields")]
    + [("http_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("block_bytes", pa.int64()), ("block", pa.binary())]
)


def captures(rows: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata, and how often its main record stands.

    Records of a transaction meet by the response's id in one exchange, with partial
    aggregates before it; records without a transaction stay out of it.
    """
    main, kind = F.col("kind").isin("response", "revisit"), F.col("kind")
    whole = F.struct("record_id", "kind", "target_uri", "payload_digest", "refers_to", "headers", "http_length", "payload_bytes", "payload_sha1", "block_bytes", "block")
    side = lambda of: F.min_by(F.struct("record_id", "target_uri", "fields", "block_bytes", "block"), F.when(kind == of, F.col("record_id")))
    return (
        rows.withColumn("capture_id", F.when(main, F.col("record_id")).when(kind.isin("request", "metadata"), F.col("concurrent_to"))).where("capture_id is not null")
        .groupBy("capture_id")
        .agg(F.min_by(whole, F.when(main, F.struct("kind", "target_uri", "payload_digest", "payload_sha1"))).alias("response"), side("request").alias("request"), side("metadata").alias("metadata"), F.count_if(main).alias("copies"))
        .where("copies > 0")
    )


def page_rows(found: DataFrame) -> DataFrame:
    """page_id, payload size and digest, record type and the page that a revisit refers to, from captures.

    The payload of a response is measured; that of a revisit is what its record says.
    """
    revisit, number = F.col("response.kind") == "revisit", lambda name: F.expr(f"try_cast(metadata.fields['{name}'] as bigint)")
    return found.select(
        number("pageId").alias("page_id"), F.when(revisit, F.col("response.http_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("response.payload_digest", "^sha1:", "")).otherwise(F.col("response.payload_sha1")).alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.when(revisit, number("refersToPageId")).alias("refers_to"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")

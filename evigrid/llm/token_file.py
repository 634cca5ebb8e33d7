"""Token-ID files with random access to short documents (operator 1).

One file set is a folder on any store that Spark writes to:

* ``dictionary``: one row, the zstandard dictionary and its sha256;
* ``blocks``: rows of documents in ascending key order.  A block holds the frames
  of its documents one behind the other (each document is one zstandard frame of
  its ids, unsigned little-endian, 2 bytes while the vocabulary allows, else 4),
  the offset index, keys, token counts, the hash of the dictionary, and how many
  tokens its part holds before it.

A reader of one document prunes blocks by ``first_key``/``last_key`` and
decompresses one frame.  Blocks close at ``BLOCK_BYTES`` of frames, so memory in a
task is bounded by a block and the longest document.

Results for odd input: null and empty texts hold the end id alone; null keys come
first; rows with equal keys stay, in the order of their texts.  An empty table
gives no blocks.  Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import sys
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evigrid.llm.bpe import WORDS, printable_bytes
from evigrid.llm.chunks import PieceTable, buffered, values
from evigrid.session import ship

BLOCK_BYTES = 4 << 20
#: Pre-tokens without a blank before them that a worker holds.
PARTS = 200_000
#: Documented bound of the dictionary's training sample: documents, and characters in each.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 1024, 4096, 64 << 10
BLOCKS = (
    "part int, first_key long, last_key long, tokens_before long, tokens long, "
    "keys array<long>, counts array<int>, offsets array<long>, width int, dict_sha256 string, frames binary"
)

_loaded: dict[str, tuple] = {}


def encoder(path: str):
    """(texts -> little-endian id bytes of each, kind of id): the tokenizers library, one per worker.

    The library's model encodes each distinct piece once for as long as it is held;
    a piece of letters alone, or with one sign behind them, is one pre-token or two,
    and a word is encoded once however signs and line ends stand about it.
    Pieces with characters beyond Latin letters or with a special token, and texts
    that cannot be cut, go through the library's whole encoder.
    """
    if path in _loaded:
        return _loaded[path]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("the short way over words holds for plain byte-level tokenizers alone")
    t.no_truncation()
    t.no_padding()
    kind = np.dtype("<u2" if t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
    special = tuple(x.content for x in t.get_added_tokens_decoder().values())
    stands, tokenize, id_of, code = {b: c for c, b in printable_bytes().items()}, t.model.tokenize, attrgetter("id"), "H" if kind.itemsize == 2 else "I"

    def word(w: str) -> bytes:
        ids = array(code, map(id_of, tokenize((w if w.isascii() else w.encode().decode("latin-1")).translate(stands))))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    signs = {c: word(c) for c in ".,;:!?"}
    parts: dict[str, bytes] = {}

    def part(w: str) -> bytes:
        """A pre-token inside a piece: words behind a blank are those of the table, others are held apart."""
        if w[0] == " " and w[1:].isalpha():
            return table[w[1:]]
        value = parts.get(w)
        if value is None:
            if len(parts) >= PARTS:
                parts.clear()
            value = parts[w] = word(w)
        return value

    def encode(text: str) -> bytes:
        if text.isascii() or max(text) < "\u0250":
            body = text[1:] if text[0] == " " else text
            if body.isalpha():
                return word(text)
            if body[:-1].isalpha() and body[-1] in signs:
                return part(text[:-1]) + signs[body[-1]]
            if not any(s in text for s in special):
                return b"".join(map(part, WORDS.findall(text)))
        return np.array(t.encode(text, add_special_tokens=False).ids, kind).tobytes()

    table = PieceTable(encode, special, 500_000)
    gc.freeze()  # what is loaded here stays, so the collector need not walk it again
    _loaded[path] = (lambda texts: values(texts, table, True), kind)
    return _loaded[path]


def train_dictionary(docs: DataFrame, tokenizer: str, key: str, text: str) -> bytes:
    """A dictionary from at most SAMPLE_DOCS short documents, spread by a hash of the key."""
    n = docs.count()
    share = min(1.0, 2.0 * SAMPLE_DOCS / max(n, 1))
    sample = docs.where((F.length(text) <= SAMPLE_CHARS) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20))).select(text).limit(SAMPLE_DOCS)

    def run(batches):
        every, _ = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(every(b.column(0).to_pylist()), pa.binary())], names=["ids"])

    arrays = [bytes(r[0]) for r in sample.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: the samples themselves are the dictionary
        return b"".join(arrays)[-DICT_BYTES:]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write the file set in key order.

    One exchange: texts are dealt by key ranges, then encoded, compressed and packed
    in their task, so ids never move between machines.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    data = train_dictionary(docs, tokenizer, "key", "text")
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, data)], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        every, kind = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        with_dict = _dict(data)
        pack = zstandard.ZstdCompressor(level=3, dict_data=with_dict) if with_dict else zstandard.ZstdCompressor(level=3)
        end = np.array([end_id], kind).tobytes()
        before, keys, counts, frames, size = 0, [], [], [], 0

        def block():
            tokens = sum(counts)
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            return pa.RecordBatch.from_pylist([{
                "part": part, "first_key": keys[0], "last_key": keys[-1], "tokens_before": before, "tokens": tokens, "keys": keys,
                "counts": counts, "offsets": offsets, "width": kind.itemsize, "dict_sha256": sha, "frames": b"".join(frames),
            }], schema=ARROW)

        for held in buffered(batches, 1):
            own = [k for b in held for k in b.column(0).to_pylist()]
            for k, ids in zip(own, every([t for b in held for t in b.column(1).to_pylist()])):
                ids += end
                keys.append(k)
                counts.append(len(ids) // kind.itemsize)
                frames.append(pack.compress(ids))
                size += len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    before += sum(counts)
                    keys, counts, frames, size = [], [], [], 0
        if keys:
            yield block()

    (docs.repartitionByRange(parts, "key").sortWithinPartitions("key", "text").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks"))


ARROW = pa.schema([
    ("part", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("tokens_before", pa.int64()), ("tokens", pa.int64()),
    ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("width", pa.int32()),
    ("dict_sha256", pa.string()), ("frames", pa.binary()),
])


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row["dictionary"]), row["dict_sha256"]


def _frames(batches, data: bytes, sha: str):
    """(key, tokens before in its part, ids) of every document, frame by frame."""
    with_dict = _dict(data)
    unpack = zstandard.ZstdDecompressor(dict_data=with_dict) if with_dict else zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(b.num_rows):
            r = {n: b.column(n)[i] for n in b.schema.names}
            if r["dict_sha256"].as_py() != sha:
                raise ValueError("block was written with another dictionary")
            frames, at, keys = memoryview(r["frames"].as_buffer()), r["offsets"].as_py(), r["keys"].as_py()
            before = r["tokens_before"].as_py()
            for k, lo, hi in zip(keys, at, at[1:]):
                ids = np.frombuffer(unpack.decompress(frames[lo:hi]), f"<u{r['width'].as_py()}")
                yield r["part"].as_py(), k, before, ids
                before += len(ids)


def read(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Documents of a file set: key, start (tokens of all documents before it), ids."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32), where)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """key, start, n_tokens and the crc32 of the ids as 32-bit numbers, from the files alone."""
    return _read(spark, path, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), None)


def _read(spark: SparkSession, path: str, made: str, make, where: str | None) -> DataFrame:
    data, sha = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    names = [x.split()[0] for x in made.split(", ")]

    def run(batches):
        rows: list[tuple] = []
        for part, k, before, ids in _frames(batches, data, sha):
            x = make(ids)
            rows.append((part, k, before, *(x if isinstance(x, tuple) else (x,))))
            if len(rows) == 2000:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)

    # one row a part; a part is an output partition of the writer, so this stays small
    base = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens")).withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    chosen = blocks if where is None else blocks.where(where)
    docs = chosen.drop("first_key", "last_key", "tokens", "counts").mapInArrow(run, f"part int, key long, before long, {made}")
    return docs.join(F.broadcast(base), "part").select("key", (F.col("base") + F.col("before")).alias("start"), *names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = {"ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *(pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(names, cols[3:]))],
        names=["part", "key", "before", *names],
    )


def read_document(spark: SparkSession, path: str, key: int) -> DataFrame:
    """One document: blocks are pruned by their key range before a frame is opened."""
    return read(spark, path, f"first_key <= {int(key)} and last_key >= {int(key)}").where(F.col("key") == int(key))

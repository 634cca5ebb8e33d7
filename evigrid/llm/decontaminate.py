"""Benchmark decontamination over a positional inverted index (operator 10).

``build_index`` reads every whole training text once and stores, block by block
of documents, each word and its positions: a document-partitioned inverted index
of all terms.  It is built without regard to any test set, and any number of them can be
asked of it later.  A position counts the words of a block with one place left free
between documents, so no run of neighbouring positions leaves its document.

``phrase_hits`` orders the terms of each test window by their number of postings
in the whole corpus and intersects the lists, shifted by their offsets, from the
rarest term on; a block tries only windows whose rarest term it holds.
``proximity_hits`` finds all terms of an item within a span, in any order.

The stored index is never dealt anew: a block is intersected where it is read.
Test items are asked in chunks of about ``CHUNK_CHARS`` characters (a longer item is a
chunk of its own), so what a task holds of them is bounded whatever the size of the test
set; a further chunk reads the index again, not the texts, and several chunks are
merged by document.

Results for odd input: null and empty texts have no words and no hits; very long texts
are blocks of their own; an item of fewer words than a window is one window, one without
words has none; equal items are all named; repeated document rows are separate rows; an
empty table gives no rows; columns of other names are ignored, and kept by ``clean``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from evigrid.session import shared_dir, ship

WINDOW, BLOCK_WORDS, CHUNK_CHARS = 10, 1 << 20, 4 << 20
#: A-Z to lower case; ASCII bytes but digits and letters part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "block string, doc_ids array<long>, n_words array<int>, starts array<long>, terms array<binary>, lengths array<int>, postings binary"
HITS = "block string, place int, doc_id long, n_words long, spans array<struct<from:int,to:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Numbers(dict):
    """Words by number, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings of all words of all documents; returns the stored index."""
    spark = ship(docs.sparkSession)
    block_words = BLOCK_WORDS

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        numbers, ids, counts, starts, found, at = Numbers(), [], [], [], [], 0

        def block():
            t = np.concatenate(found)
            p = np.concatenate([np.arange(n) + s for n, s in zip(counts, starts)])
            order = np.argsort(t, kind="stable")
            p, lengths = p[order], np.bincount(t, minlength=len(numbers))
            gaps = np.diff(p, prepend=0)
            first = (np.cumsum(lengths) - lengths)[lengths > 0]
            gaps[first] = p[first]  # each list starts anew
            data = zstandard.ZstdCompressor(level=1).compress(gaps.astype("<u4").tobytes())
            return pa.RecordBatch.from_pylist([{"block": f"{part}-{number}", "doc_ids": ids, "n_words": counts, "starts": starts, "terms": list(numbers), "lengths": lengths, "postings": data}], schema=ARROW)

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                own = words(x.as_py())
                found.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                ids.append(k)
                counts.append(len(own))
                starts.append(at)
                at += len(own) + 1
                if at >= block_words:
                    yield block()
                    number += 1
                    numbers, ids, counts, starts, found, at = Numbers(), [], [], [], [], 0
        if ids:
            yield block()

    docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


ARROW = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("postings", pa.binary())])


def term_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """Postings of each asked term over the whole corpus; as many rows as a chunk of items has terms."""

    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for terms, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in zip(terms, lengths):
                    if w in vocabulary:
                        total[vocabulary[w]] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    found = index.select("terms", "lengths").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.toLocalIterator()}


def _lists(row, vocabulary: dict[bytes, int]) -> dict[int, np.ndarray]:
    """The block's postings of asked terms."""
    gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"]), "<u4")
    ends = np.cumsum(row["lengths"])
    asked = [(vocabulary[w], i) for i, w in enumerate(row["terms"]) if w in vocabulary]
    return {t: np.cumsum(gaps[ends[i] - row["lengths"][i] : ends[i]].astype(np.int64)) for t, i in asked}


def _in(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def _report(row, found: list[tuple[np.ndarray, int, tuple]]) -> pa.RecordBatch:
    """One row a document of the block: merged spans and item names. found: (starts, length, items)."""
    starts = np.asarray(row["starts"])
    spans, items = defaultdict(list), defaultdict(set)
    for at, length, names in found:
        doc = np.searchsorted(starts, at, "right") - 1
        for d, p in zip(doc.tolist(), (at - starts[doc]).tolist()):
            spans[d].append((p, p + length))
            items[d].update(names)
    merged = []
    for d in range(len(starts)):
        out: list[dict] = []
        for lo, hi in sorted(spans.get(d, ())):
            if out and lo <= out[-1]["to"]:
                out[-1]["to"] = max(out[-1]["to"], hi)
            else:
                out.append({"from": lo, "to": hi})
        merged.append(out)
    n = len(starts)
    return pa.RecordBatch.from_arrays([
        pa.array([row["block"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()),
        pa.array(merged, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
    ], names=["block", "place", "doc_id", "n_words", "spans", "items"])


def _over_blocks(index: DataFrame, find) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                yield _report(row, list(find(row)))

    return index.mapInArrow(run, HITS)


def phrase_hits(index: DataFrame, vocabulary: dict[bytes, int], windows: dict[tuple[int, ...], tuple[str, ...]], counts: dict[int, int]) -> DataFrame:
    """Exact occurrences of windows (term numbers -> item names): one row a document, hit or not."""
    plan = defaultdict(list)  # by the rarest term
    for w, names in windows.items():
        if all(counts.get(t) for t in w):
            order = [(t, o) for _, o, t in sorted((counts[t], o, t) for o, t in enumerate(w))]
            plan[order[0][0]].append((order, len(w), names))

    def find(row):
        lists = _lists(row, vocabulary)
        for rarest in sorted(lists.keys() & plan.keys()):
            for order, length, names in plan[rarest]:
                at = lists[rarest] - order[0][1]
                for t, offset in order[1:]:
                    places = lists.get(t)
                    at = at[:0] if places is None else at[_in(places, at + offset)]
                    if not len(at):
                        break
                else:
                    yield at, length, names

    return _over_blocks(index, find)


def proximity_hits(index: DataFrame, vocabulary: dict[bytes, int], items: dict[tuple[int, ...], tuple[str, ...]], counts: dict[int, int], slop: int) -> DataFrame:
    """Places where all terms of an item lie within its length plus ``slop`` words of one document, in any order."""
    plan = [(sorted(set(w), key=lambda t: (counts.get(t, 0), t)), len(w) + slop, names) for w, names in items.items() if all(counts.get(t) for t in w)]

    def find(row):
        lists, starts = _lists(row, vocabulary), np.asarray(row["starts"])
        for terms, span, names in plan:
            if any(t not in lists for t in terms):
                continue
            rare = lists[terms[0]]
            first = (rare[:, None] - np.arange(span)).ravel()
            doc = np.repeat(np.searchsorted(starts, rare, "right") - 1, span)
            ok = first >= starts[doc]
            first, doc = first[ok], doc[ok]
            low, high = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
            for t in terms:
                places = lists[t]
                at = np.searchsorted(places, first)
                there = places[np.minimum(at, len(places) - 1)]
                ok = (at < len(places)) & (there < first + span) & (np.searchsorted(starts, there, "right") - 1 == doc)
                first, doc, low, high = first[ok], doc[ok], np.minimum(low, there)[ok], np.maximum(high, there)[ok]
                if not len(first):
                    break
            for lo, hi in sorted(set(zip(low.tolist(), high.tolist()))):
                yield np.array([lo]), hi - lo + 1, names

    return _over_blocks(index, find)


def _chunks(items: DataFrame, item: str, text: str):
    """Test items a bounded number of characters at a time."""
    chunk, size, any_yet = [], 0, False
    for r in items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).toLocalIterator():
        own = words(r["text"])
        if own:
            chunk.append((r["item"], own))
            size += len(r["text"])
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size, any_yet = [], 0, True
    if chunk or not any_yet:
        yield chunk


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, merged hit ``spans`` and the ``items`` found.

    With ``slop`` whole items are looked for by proximity, else windows as exact phrases.
    """
    index = build_index(docs, f"{shared_dir(docs.sparkSession)}/index", key, text)
    return search_index(index, items, item, item_text, window, slop)


def search_index(index: DataFrame, items: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``search`` on a stored index."""
    ship(index.sparkSession)
    found = []
    for chunk in _chunks(items, item, item_text):
        vocabulary = Numbers()
        wanted: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, own in chunk:
            terms = [vocabulary[w] for w in own]
            size = len(terms) if slop is not None else min(window, len(terms))
            for i in range(len(terms) - size + 1):
                wanted[tuple(terms[i : i + size])].add(name)
        wanted = {w: tuple(sorted(names)) for w, names in wanted.items()}
        asked = dict(vocabulary)
        counts = term_counts(index, asked)
        found.append(phrase_hits(index, asked, wanted, counts) if slop is None else proximity_hits(index, asked, wanted, counts, slop))
    if len(found) == 1:
        return found[0].drop("block", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return (
        every.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .drop("block", "place")
    )


def covered(spans: str = "spans"):
    """Words under any of the spans."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["to"]).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """Digest of ``search``: words, hit words, items and their sha256."""
    hits = search(docs, items, **names)
    return hits.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """The documents without a hit, with the columns of ``docs``."""
    bad = search(docs, items, key=key, **names).where(F.size("items") > 0).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[key].cast("long").eqNullSafe(F.col("_bad")), "left_anti")

"""Alignment of two tokenizers over a corpus, with link counts under a minimal perfect hash (operator 11).

``A`` is a byte-level tokenizer that gets a blank before the text, ``B`` a sentence-piece one that adds
it itself, so both cut the same bytes.  Offsets where tokens of both end cut the bytes into groups;
a token of A and one of B in one group are linked.

1. ``encode`` writes the ids of both sides, a row for each buffer of texts, equal words once.
2. ``pair_counts``, first pass: each buffer gives its distinct linked id pairs with the number of its
   documents that hold them.
3. Distinct pairs are dealt into shards of about ``SHARD_KEYS`` keys; a task builds the minimal perfect
   hash of a shard and keeps its keys in hash order.
4. Tasks add the counts of step 2 into dense vectors indexed by hash, after the key at that place is
   verified; vectors are summed in a tree of ``FAN`` branches.
5. ``align``, second pass: documents are aligned again and their pairs looked up.

What is broadcast is a group of shards of at most ``GROUP_KEYS`` keys (and a number for each id of A);
with more keys, documents pass once for each group and their sums are carried along, so the result is
the same at every size.  Equal words of a buffer are encoded and aligned once: neither tokenizer joins
characters over a blank between two others, which ``Tokenizers`` checks of the vocabulary; a text where
a blank stands beside white space is encoded whole.

Results for odd input: null and empty texts, and texts whose tokens do not spell the blank and the text
byte by byte (the sentence-piece blank sign in them, for one), have no tokens: zeros and an empty digest.
Strings of special tokens are plain text.  Rows with null or equal keys each count as a document; an
empty table gives no rows; very long texts and groups are whole (pairs of a large group are counted by
distinct ids with their number); other columns are left out, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.llm.bpe import printable_bytes
from evigrid.llm.chunks import UNCUT
from evigrid.llm.perfect_hash import PerfectHash, shard_of
from evigrid.session import ship, stored

SHARD_KEYS, GROUP_KEYS, FAN = 1 << 17, 1 << 22, 16
#: Words whose token ids a worker remembers before it begins anew.
REMEMBERED = 150_000
#: Groups with more links than this are counted by distinct ids.
LARGE = 1 << 10
#: Characters of text in one row of ids, and in one call of a tokenizer.
BUFFER, TOGETHER = 1 << 20, 1 << 16
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
_BLANK = "▁"


class Tokenizers:
    """Both tokenizers of a worker, the bytes of their tokens, and ids of words encoded before."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        stands = printable_bytes()
        spelt = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(stands[c] for c in s) if all(c in stands for c in s) else s.encode() for s in spelt]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.match(p)) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.cuts = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)  # else only whole texts are safe
        self._forget()
        self.kinds = {c: "<u2" if len(x) <= 1 << 16 else "<i4" for c, x in (("a", spelt), ("b", pieces))}
        digits = [b"%d" % i for i in range(max(len(spelt), len(pieces)))]
        self.digits = np.array([len(d) for d in digits])
        self.spelt = {c: np.array([d + c.encode() for d in digits]) for c in ",|;"}

    def _forget(self) -> None:
        #: text without the blank before it -> its number; -1 tokens of A where they do not spell it
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.a_ids, self.b_ids = _Rows(), _Rows()
        self.good, self.spelling = np.empty(0, bool), []

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of its words; all of them are encoded when this returns."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, before, out = self.known, len(self.known), []
        for t in texts:
            if not t:
                out.append(np.empty(0, np.int64))
            elif not self.cuts or t[0].isspace() or UNCUT.search(t):
                out.append(np.array([known[t]]))
            else:
                pieces = t.split(" ")
                out.append(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))
        self._encode(list(islice(known, before, None)))
        self.good, self.spelling = np.concatenate([self.good, *self.spelling]), []
        return out

    def _encode(self, texts: list[str]) -> None:
        """Encode new texts, in order of their numbers."""
        size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts)) + 1
        alone = [" " in t or t[0].isspace() or not self.cuts for t in texts]
        lots, lo, chars = [], 0, 0
        for i, x in enumerate(alone):
            chars += size[i]
            if x or chars >= TOGETHER or i + 1 == len(texts) or alone[i + 1]:
                lots.append((lo, i + 1))
                lo, chars = i + 1, 0
        for at in range(0, len(lots), 8):  # an encoding holds far more than its ids
            some = lots[at : at + 8]
            joined = [" " + " ".join(texts[x:y]) for x, y in some]
            a, b = self._both(joined)
            for (x, y), s, one, two in zip(some, joined, a, b):
                spelt = s.encode()
                if self._spells(one, two, spelt):
                    self._keep(one, two, np.cumsum(size[x:y]), np.ones(y - x, bool))
                else:
                    for t in texts[x:y]:
                        (one,), (two,) = self._both([" " + t])
                        ok = self._spells(one, two, (" " + t).encode())
                        self._keep(one if ok else [], two if ok else [], np.array([len(t.encode()) + 1]), np.array([ok]))

    def _both(self, texts: list[str]) -> tuple[list, list]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([s[1:] for s in texts], num_threads=1)

    def _spells(self, a: list[int], b: list[int], text: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == text and b"".join(map(self.bytes_b.__getitem__, b)) == text

    def _keep(self, a: list[int], b: list[int], ends: np.ndarray, good: np.ndarray) -> None:
        for rows, ids, wide in ((self.a_ids, np.array(a, np.int32), self.len_a), (self.b_ids, np.array(b, np.int32), self.len_b)):
            rows.add(ids, np.diff(np.searchsorted(np.cumsum(wide[ids]), ends, "right"), prepend=0))
        self.spelling.append(good)


class _Rows:
    """Rows of numbers of different lengths, one behind the other; rows are only added."""

    def __init__(self):
        self.parts, self.sizes, self.data, self.n = [], [], np.empty(0, np.int32), np.empty(0, np.int64)

    def add(self, data: np.ndarray, n: np.ndarray) -> None:
        self.parts.append(data)
        self.sizes.append(n)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows, and how many each has."""
        if self.parts:
            self.data, self.n = np.concatenate([self.data, *self.parts]), np.concatenate([self.n, *self.sizes])
            self.start = np.cumsum(self.n) - self.n
            self.parts, self.sizes = [], []
        n = self.n[rows]
        return self.data[_ranges(self.start[rows], n)] if len(rows) else np.empty(0, np.int32), n


_loaded: dict[tuple, Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
        gc.freeze()
    return _loaded[a_path, b_path]


IDS = "keys array<long>, sizes binary, words binary, n_a binary, n_b binary, a binary, b binary"


COLUMNS = [x.split()[0] for x in IDS.split(", ")][1:]


def encoded(texts: list[str | None], both: Tokenizers) -> dict[str, np.ndarray]:
    """Token ids of both sides of the distinct words of some texts, and which words each text has in order."""
    words = both.numbers(texts)
    words = [w if both.good[w].all() else w[:0] for w in words]  # a text with a word that is not spelt has no tokens
    distinct, places = np.unique(np.concatenate([np.empty(0, np.int64), *words]), return_inverse=True)
    (a, n_a), (b, n_b) = both.a_ids.of(distinct), both.b_ids.of(distinct)
    return {"sizes": np.array(list(map(len, words)), np.int32), "words": places.astype(np.int32), "n_a": n_a.astype(np.int32), "n_b": n_b.astype(np.int32), "a": a, "b": b}


class Aligned:
    """The distinct words of a buffer of texts, aligned: numbers of tokens, groups and links of each, and the links.

    ``words[i]`` are the places of the words of text i; empty for a text without tokens.
    """

    def __init__(self, ids: dict[str, np.ndarray], both: Tokenizers):
        self.both = both
        self.words = np.split(ids["words"].astype(np.int64), np.cumsum(ids["sizes"])[:-1]) if len(ids["sizes"]) else []
        self.a, self.b, self.n_a, self.n_b = (ids[c].astype(np.int64) for c in ("a", "b", "n_a", "n_b"))
        self._groups()
        self._links()

    def _groups(self) -> None:
        end_a, end_b = np.cumsum(self.both.len_a[self.a]), np.cumsum(self.both.len_b[self.b])
        at = np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))
        common = end_b[at] == end_a if len(end_b) else np.zeros(len(end_a), bool)
        ends = end_a[common]
        self.group_a, self.group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(ends)), np.bincount(self.group_b, minlength=len(ends))
        word_of_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.word_of_group = word_of_a[common]
        self.n_groups = np.bincount(self.word_of_group, minlength=len(self.n_a))
        self.n_links = np.bincount(self.word_of_group, weights=self.in_a * self.in_b, minlength=len(self.n_a)).astype(np.int64)

    def _links(self) -> None:
        """pair (A id << 32 | B id), weight and owning word of each link, in order of words."""
        first_b = np.cumsum(self.in_b) - self.in_b
        large = self.in_a * self.in_b > LARGE
        plain = ~large[self.group_a]
        a, g = self.a[plain], self.group_a[plain]
        n = self.in_b[g]
        pair = np.repeat(a, n) << 32 | self.b[_ranges(first_b[g], n)]
        weight, word = np.ones(len(pair), np.int64), np.repeat(self.word_of_group[g], n)
        if large.any():
            first_a = np.cumsum(self.in_a) - self.in_a
            pairs, weights, owners = [pair], [weight], [word]
            for k in np.flatnonzero(large):
                x, nx = np.unique(self.a[first_a[k] : first_a[k] + self.in_a[k]], return_counts=True)
                y, ny = np.unique(self.b[first_b[k] : first_b[k] + self.in_b[k]], return_counts=True)
                pairs.append((x[:, None] << 32 | y).ravel())
                weights.append((nx[:, None] * ny).ravel())
                owners.append(np.full(len(x) * len(y), self.word_of_group[k]))
            pair, weight, word = map(np.concatenate, (pairs, weights, owners))
            order = np.argsort(word, kind="stable")
            pair, weight, word = pair[order], weight[order], word[order]
        self.pairs, self.at = np.unique(pair, return_inverse=True)
        self.weight, self.of_word = weight, word
        self.links_of = np.bincount(word, minlength=len(self.n_a))

    def documents_with(self) -> np.ndarray:
        """For each distinct pair, how many of the texts hold it linked."""
        held, start = np.zeros(len(self.pairs), np.int64), np.cumsum(self.links_of) - self.links_of
        seen_word, seen_pair = np.empty(len(self.n_a), np.int64), np.empty(len(self.pairs), np.int64)
        for w in self.words:
            w = _once(w, seen_word)
            p = self.at[_ranges(start[w], self.links_of[w])]
            held[_once(p, seen_pair)] += 1
        return held

    def totals(self, of_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        return np.array([of_word[w].sum() for w in self.words], np.int64).reshape(-1)

    def summed(self, of_pair: np.ndarray) -> np.ndarray:
        """Sums over the links of each word, as whole numbers."""
        out = np.zeros(len(self.n_a), np.int64)
        np.add.at(out, self.of_word, self.weight * of_pair[self.at])
        return out

    def digests(self) -> list[str]:
        """sha256 of the groups written out, '' for a text without tokens."""
        place = np.cumsum(self.in_a + self.in_b) - (self.in_a + self.in_b)
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        kind = self.both.spelt[","].dtype
        text = np.zeros(len(self.a) + len(self.b), kind)
        wide = np.zeros(len(text), np.int64)
        for ids, group, n, first, base, stop in ((self.a, self.group_a, self.in_a, first_a, place, "|"), (self.b, self.group_b, self.in_b, first_b, place + self.in_a, ";")):
            k = np.arange(len(ids)) - first[group]
            last = k == n[group] - 1
            spot = base[group] + k
            text[spot] = np.where(last, self.both.spelt[stop][ids], self.both.spelt[","][ids])
            wide[spot] = self.both.digits[ids] + 1
        data = text.tobytes().replace(b"\0", b"")
        n = self.n_a + self.n_b
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(n)])].tolist()
        parts = [data[x:y] for x, y in zip(ends, ends[1:])]
        return [hashlib.sha256(b"".join(map(parts.__getitem__, w.tolist()))[:-1]).hexdigest() if len(w) else "" for w in self.words]

    def groups(self) -> list[list[dict]]:
        """The groups of each text: token ids of both sides."""
        ends_a, ends_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        first = np.cumsum(self.n_groups) - self.n_groups
        made = [{"a": self.a[x - n : x].tolist(), "b": self.b[y - m : y].tolist()} for x, n, y, m in zip(ends_a, self.in_a, ends_b, self.in_b)]
        return [[made[g] for g in _ranges(first[w], self.n_groups[w])] for w in self.words]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _once(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """x without repeats, by means of a scratch array over its values."""
    i = np.arange(len(x))
    scratch[x] = i
    return x[scratch[x] == i]


def encode(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of both sides, a row for each buffer of texts: equal words of a buffer are kept once."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in IDS.split(", ")]

    def run(batches):
        both = tokenizers(a, b)
        for keys, texts in _lots(batches):
            made = encoded(texts, both)
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), *(pa.array([made[c].astype(both.kinds.get(c, "<i4")).tobytes()], pa.binary()) for c in names[1:])], names=names)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, IDS)


def _lots(batches) -> Iterator[tuple[list, list]]:
    """Keys and texts of about BUFFER bytes of text at a time."""
    keys, texts, size = [], [], 0
    for x in batches:
        for k, t in zip(x.column(0), x.column(1)):
            keys.append(k.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= BUFFER:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _buffers(batches, a: str, b: str) -> Iterator[tuple[pa.Array, Aligned]]:
    """Keys and alignment of each row of ``encode``."""
    both = tokenizers(a, b)
    for x in batches:
        for i in range(x.num_rows):
            yield x.column("keys")[i].values, Aligned({c: np.frombuffer(x.column(c)[i].as_buffer(), both.kinds.get(c, "<i4")) for c in COLUMNS}, both)


def groups(ids: DataFrame, a: str, b: str) -> DataFrame:
    """(key, groups) of the rows of ``encode``: the token ids of both sides of every group, in order."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        for keys, found in _buffers(batches, a, b):
            yield pa.RecordBatch.from_arrays([keys, pa.array(found.groups(), kind)], names=["key", "groups"])

    return ids.mapInArrow(run, "key long, groups array<struct<a: array<int>, b: array<int>>>")


def _partial_counts(ids: DataFrame, a: str, b: str) -> DataFrame:
    """Per buffer of texts its distinct pairs and how many of its documents hold each."""

    def run(batches):
        for _, found in _buffers(batches, a, b):
            yield pa.RecordBatch.from_arrays([pa.array([found.pairs], pa.list_(pa.int64())), pa.array([found.documents_with()], pa.list_(pa.int64()))], names=["pairs", "held"])
            del found  # before the next one is made

    return ids.mapInArrow(run, "pairs array<long>, held array<long>")


HASHES = "shard int, n long, sizes binary, bits binary, rest binary, keys binary"


def _hash_shard(rows: pa.Table) -> pa.Table:
    keys = np.sort(rows.column("pair").to_numpy())
    h = PerfectHash.of(keys)
    parts = [x.astype("<i8").tobytes() for x in (h.sizes, h.rest, h.keys)]
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "sizes": [parts[0]], "bits": [h.bits.tobytes()], "rest": [parts[1]], "keys": [parts[2]]})


class Held:
    """Hashes of a group of shards as a worker holds them, with their counts once they are summed."""

    def __init__(self, rows: list, shards: int):
        self.shards, self.hashes, self.counts = shards, {}, {}
        for r in rows:
            wide = lambda c: np.frombuffer(r[c], "<i8")  # noqa: B023, E731
            self.hashes[r["shard"]] = PerfectHash(wide("sizes"), np.frombuffer(r["bits"], np.uint8), wide("rest"), wide("keys"))
            if "counts" in r:
                self.counts[r["shard"]] = wide("counts")

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, -1 where it belongs to a shard of another group."""
        out, of = np.full(len(pairs), -1, np.int64), shard_of(pairs, self.shards)
        for s in np.unique(of).tolist():
            if s in self.hashes:
                at = np.flatnonzero(of == s)
                number = self.hashes[s].find(pairs[at])
                if (number < 0).any():
                    raise ValueError("a pair is not among the hashed ones: the documents have changed between the passes")
                out[at] = self.counts[s][number]
        return out


def in_groups(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards of these sizes in groups of at most ``most`` together (a larger shard is a group of its own)."""
    out, room = [], 0
    for shard, n in sizes:
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(shard)
        room -= n
    return out


def _broadcast(rows: DataFrame, shards: list[int], of: int):
    """A group of shards as a broadcast of at most GROUP_KEYS keys."""
    found = [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in rows.where(F.col("shard").isin(shards)).collect()]
    return rows.sparkSession.sparkContext.broadcast((found, of))


class PairCounts:
    """Stored shards: hash, keys in hash order and the documents that hold each pair linked."""

    def __init__(self, table: DataFrame, shards: int, groups: list[list[int]]):
        self.table, self.shards, self.groups = table, shards, groups

    def pairs(self) -> DataFrame:
        """(a, b, documents) of every linked pair of ids."""

        def run(batches):
            for x in batches:
                for keys, counts in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    k = np.frombuffer(keys, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(k >> 32, pa.int64()), pa.array(k & 0xFFFFFFFF, pa.int64()), pa.array(np.frombuffer(counts, "<i8"))], names=["a", "b", "documents"])

        return self.table.select("keys", "counts").mapInArrow(run, "a long, b long, documents long")

    def best(self) -> np.ndarray:
        """The highest count of each id of A; as many numbers as A has ids."""
        rows = self.pairs().groupBy("a").agg(F.max("documents").alias("m")).toPandas()
        out = np.zeros(int(rows["a"].max()) + 1 if len(rows) else 1, np.int64)
        out[rows["a"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
        return out


def pair_counts(ids: DataFrame, a: str, b: str) -> PairCounts:
    """First pass over the rows of ``encode``: how many documents hold each pair of ids linked."""
    spark = ship(ids.sparkSession)
    parts = stored(_partial_counts(ids, a, b))
    distinct = stored(parts.select(F.explode("pairs").alias("pair")).distinct())
    shards = max(1, -(-distinct.count() // SHARD_KEYS))

    def dealt(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(shard_of(x.column(0).to_numpy(), shards))], names=["pair", "shard"])

    hashes = stored(distinct.mapInArrow(dealt, "pair long, shard int").groupBy("shard").applyInArrow(_hash_shard, HASHES))
    grouped = in_groups(sorted((r["shard"], r["n"]) for r in hashes.select("shard", "n").collect()), GROUP_KEYS)
    sums = None
    for group in grouped:
        bc = _broadcast(hashes, group, shards)

        def vectors(batches, bc=bc):
            from pyspark import TaskContext

            table = Held(*bc.value)
            dense = {s: np.zeros(len(h.keys), np.int64) for s, h in table.hashes.items()}
            for x in batches:
                for i in range(x.num_rows):
                    pairs, held = (x.column(c)[i].values.to_numpy() for c in (0, 1))
                    of = shard_of(pairs, shards)
                    for s in np.unique(of).tolist():
                        if s in dense:
                            mine = of == s
                            at = table.hashes[s].find(pairs[mine])
                            if (at < 0).any():
                                raise ValueError("a pair is not among the hashed ones")
                            dense[s][at] += held[mine]
            node = TaskContext.get().partitionId()
            for s, v in dense.items():
                if v.any():
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([node], pa.int32()), pa.array([v.astype("<i8").tobytes()])], names=["shard", "node", "counts"])

        made = stored(parts.mapInArrow(vectors, "shard int, node int, counts binary"))
        sums = made if sums is None else sums.unionByName(made)
    counts = tree_sum(sums) if sums is not None else spark.createDataFrame([], "shard int, node int, counts binary")
    return PairCounts(stored(hashes.join(counts.select("shard", "counts"), "shard")), shards, grouped)


def tree_sum(vectors: DataFrame) -> DataFrame:
    """Vectors (shard, node, counts) of longs to one a shard, FAN at a time."""
    kind = f"shard {vectors.schema['shard'].dataType.simpleString()}, node int, counts binary"

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), "<i8") for v in rows.column("counts"))
        return pa.table({"shard": rows.column("shard").slice(0, 1), "node": rows.column("node").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()])})

    while True:
        nodes = vectors.agg(F.max("node")).first()[0]
        if not nodes:
            return vectors
        vectors = stored(vectors.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("shard", "node").applyInArrow(add, kind))


SUMS = "n_best long, count_sum long"
FOUND = f"key long, n_a long, n_b long, n_groups long, n_links long, {SUMS}, groups_sha256 string"


def align(ids: DataFrame, counts: PairCounts, a: str, b: str) -> DataFrame:
    """Second pass over the rows of ``encode``: one row a document with its sizes, the sums of its pairs' counts and the digest of its groups."""
    spark = ship(ids.sparkSession)
    best = spark.sparkContext.broadcast(counts.best())
    *early, last = counts.groups or [[]]
    for group in early:  # sums over the links of these shards are carried along
        ids = stored(_looked_up(ids, counts, group, best, a, b, False))
    return _looked_up(ids, counts, last, best, a, b, True)


def _looked_up(ids: DataFrame, counts: PairCounts, group: list[int], best, a: str, b: str, last: bool) -> DataFrame:
    bc, names = _broadcast(counts.table, group, counts.shards), [x.split()[0] for x in FOUND.split(", ")]
    carried = "summed_best" in ids.columns

    def run(batches):
        table, top = Held(*bc.value), best.value
        for x in batches:
            for i in range(x.num_rows):
                keys, found = next(_buffers([x.slice(i, 1)], a, b))
                n = table.look_up(found.pairs)
                most = (n >= 0) & (n == top[np.minimum(found.pairs >> 32, len(top) - 1)])
                sums = [found.totals(found.summed(v)) for v in (most.astype(np.int64), np.maximum(n, 0))]
                if carried:
                    sums = [v + x.column(c)[i].values.to_numpy() for v, c in zip(sums, ("summed_best", "summed_count"))]
                if last:
                    made = [pa.array(found.totals(getattr(found, c))) for c in names[1:5]]
                    yield pa.RecordBatch.from_arrays([keys, *made, *map(pa.array, sums), pa.array(found.digests(), pa.string())], names=names)
                else:
                    kept = x.slice(i, 1).select([c for c in x.schema.names if not c.startswith("summed_")])
                    for c, v in zip(("summed_best", "summed_count"), sums):
                        kept = kept.append_column(c, pa.array([v], pa.list_(pa.int64())))
                    yield kept
                del found, sums, n, most  # before the next one is made

    return ids.mapInArrow(run, FOUND if last else f"{IDS}, summed_best array<long>, summed_count array<long>")

"""Phrase collocations by broadcast double-array tries (operator 12).

Texts are folded (A-Z) and cut at ``. , ; : ! ?`` and line ends into pieces, pieces at blanks and tabs
into words.  Everything is counted by language (null: ``und``).

1. ``_bounds``: upper bounds of counts by hashed buckets, first of words, then of pairs whose words pass,
   then of triples whose pairs pass (Apriori): a phrase under ``LEAST`` occurrences is left out only when its bucket, or that
   of a part, says so.  Buckets come back as one bit each.
2. ``candidates``: the distinct phrases of 2 to ``MOST_WORDS`` words whose own bucket and those of all
   their parts pass, and their words.
3. Sorted candidates are cut into ranges of about ``TRIE_KEYS``; a task builds the double-array trie of
   a range.  Tries are broadcast in groups of at most ``GROUP_PLACES`` places.
4. ``counted``: all word positions of a buffer of texts advance through the tries together, a byte a
   step; accepting states are counted into dense vectors, which are summed in a tree.
5. ``score``: joins of phrases with their parts, exact in decimals; a candidate goes if a longer one
   that holds it has at least ``INSIDE`` percent of its occurrences.

The tries only grow with the candidates, in more groups: the texts pass once for each group.  Results
for odd input: null and empty texts have no words; a null language is ``und``; repeated rows count
each; very long words and texts are whole; ties go by the stated order; an empty table gives no rows;
other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evigrid.llm.alignment import in_groups, tree_sum
from evigrid.llm.bucket_filter import ROWS, Gathered, bits_for, frequent, passes
from evigrid.llm.chunks import _all_equal, _piece_hashes
from evigrid.llm.double_array import DoubleArray, _spans
from evigrid.llm.shingles import _ODD, mix
from evigrid.session import ship, stored

LEAST, MOST_WORDS, INSIDE, FIRST = 10, 3, 50, 2000
TRIE_KEYS, GROUP_PLACES = 1 << 17, 1 << 24
#: Shares of first words, by hash, in which candidates meet.
SHARES = 32
#: Bytes of text that a task looks at together.
TOGETHER = 4 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[46, 44, 59, 58, 33, 63, 11, 12, 13]] = 10
_FOLD[9] = 32
_ENDS = np.zeros(256, bool)
_ENDS[[10, 32]] = True


class Words:
    """The words of some texts: bytes with one sign behind each word (a blank before a word of the same piece, else a line end)."""

    def __init__(self, texts: list[str], langs: list[str]):
        encoded = [t.encode() for t in texts]
        data = _FOLD[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
        word = (data != 10) & (data != 32)
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        breaks = np.cumsum(data == 10, dtype=np.int32)[start]
        doc_end = np.cumsum([len(t) + 1 for t in encoded])
        self.doc = np.searchsorted(doc_end, start, "right")
        same = np.zeros(len(start), bool)  # the next word is of the same piece
        same[:-1] = breaks[1:] == breaks[:-1]
        word[end] = True
        data[end] = np.where(same, 32, 10)
        self.bytes = data[word]
        size = end - start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.same = same
        names, code = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        self.langs, self.lang = names.tolist(), code[self.doc]
        salt = np.array([hash_text(n) for n in self.langs], np.uint64)
        self.hash = mix(_piece_hashes(self.bytes, self.start, self.end) ^ salt[self.lang])

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all phrases of n words, and the phrases' hashes."""
        ok = np.ones(max(len(self.hash) - n + 1, 0), bool)
        for k in range(n - 1):
            ok &= self.same[k : k + len(ok)]
        at = np.flatnonzero(ok)
        return at, self.hashes(at, n)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return self.hash[at]
        total = self.hash[at] * _ODD[0]
        for k in range(1, n):
            total += self.hash[at + k] * _ODD[k]
        return mix(total)


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode())


def _buffers(batches):
    """Words of about TOGETHER bytes of texts at a time."""
    texts, langs, size = [], [], 0
    for b in batches:
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                texts.append(t)
                langs.append(lang)
                size += len(t)
            if size >= TOGETHER:
                yield Words(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def _passing(words: Words, n: int, maps: dict, bits: dict) -> np.ndarray:
    """Places of phrases of n words all of whose parts' buckets pass, as far as there are bits for them."""
    at, h = words.phrases(n)
    for k in range(1, n):
        if k in maps:
            for i in range(n - k + 1):
                keep = passes(maps[k], words.hashes(at + i, k), bits[k])
                at, h = at[keep], h[keep]
    if n in maps:
        at = at[passes(maps[n], h, bits[n])]
    return at


def _bounds(texts: DataFrame, levels: tuple[int, ...], bits: dict, maps, totals: bool) -> DataFrame:
    """Buckets of all phrases of these lengths whose words pass; with ``totals`` also words by language (level 0)."""

    def run(batches):
        known, gathered = maps.value if maps else {}, Gathered(bits, LEAST)

        def wide(rows):
            for b in rows:
                yield b.append_column("lang", pa.nulls(b.num_rows, pa.string())).append_column("n", pa.nulls(b.num_rows, pa.int64()))

        for words in _buffers(batches):
            for n in levels:
                at = _passing(words, n, {k: v for k, v in known.items() if k < n}, bits)
                yield from wide(gathered.put(n, words.hashes(at, n)))
            if totals:
                n = np.bincount(words.lang, minlength=len(words.langs))
                none = pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(np.zeros(len(n), np.int32)), none, none, pa.array(words.langs), pa.array(n, pa.int64())], names=["level", "range", "buckets", "held", "lang", "n"])
        yield from wide(gathered.rest())

    return texts.mapInArrow(run, f"{ROWS}, lang string, n long")


def _emitted(texts: DataFrame, bits: dict, maps) -> DataFrame:
    """(lang, phrase): the distinct candidates.

    Those of a buffer move packed: by language and first word, sorted, so that neighbours share most of their bytes.
    A task puts together one language's share of first words at a time.
    """
    import zstandard

    def pack(batches):
        known, small = maps.value, zstandard.ZstdCompressor(level=9)
        for words in _buffers(batches):
            own = []
            for n in range(2, MOST_WORDS + 1):
                at = _passing(words, n, known, bits)
                if not len(at):
                    continue
                start, end = words.start[at], words.end[at + n - 1]
                h = words.hashes(at, n)
                _, like, inverse = np.unique(h, return_index=True, return_inverse=True)
                if not _all_equal(words.bytes, start, end, like[inverse]):
                    like = np.arange(len(at))
                own.append((at[like], start[like], end[like]))
            if own:
                at, start, end = map(np.concatenate, zip(*own))
                code = words.lang[at].astype(np.int64) * SHARES + (words.hash[at] % np.uint64(SHARES)).astype(np.int64)
                order = np.argsort(code, kind="stable")
                cut = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1)).tolist()
                raw, start, end = words.bytes.tobytes(), start[order].tolist(), end[order].tolist()
                packed = [small.compress(b"\n".join(sorted([raw[s:e] for s, e in zip(start[lo:hi], end[lo:hi])]))) for lo, hi in zip(cut, cut[1:])]
                group = code[order][cut[:-1]]
                lang = pa.DictionaryArray.from_arrays(pa.array((group // SHARES).astype(np.int32)), pa.array(words.langs)).dictionary_decode()
                yield pa.RecordBatch.from_arrays([lang, pa.array((group % SHARES).astype(np.int32)), pa.array(packed, pa.binary())], names=["lang", "range", "phrases"])

    def meet(batches):
        plain, group, held = zstandard.ZstdDecompressor(), None, set()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(held), pa.string()), pa.array(list(held), pa.binary()).cast(pa.string())], names=["lang", "phrase"])

        for b in batches:
            for lang, r, phrases in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, r) != group:
                    if held:
                        yield rows()
                    group, held = (lang, r), set()
                held.update(plain.decompress(phrases).split(b"\n"))
        if held:
            yield rows()

    packed = texts.mapInArrow(pack, "lang string, range int, phrases binary").repartition("lang", "range").sortWithinPartitions("lang", "range")
    return packed.mapInArrow(meet, "lang string, phrase string")


TRIES = "trie long, lang string, lo long, hi long, places long, base binary, check binary, phrases array<string>"


def _first_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number in byte order; data has seven bytes to spare."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def _signed(x: np.ndarray) -> list[int]:
    return (x ^ np.uint64(1 << 63)).view(np.int64).tolist()


def _trie_rows(batches):
    """A trie for each language of a sorted range of candidates."""
    from pyspark import TaskContext

    part, langs, phrases = TaskContext.get().partitionId(), [], []
    for b in batches:
        langs += b.column(0).to_pylist()
        phrases += b.column(1).to_pylist()
    lo, k = 0, 0
    while lo < len(langs):
        hi = next((i for i in range(lo, len(langs)) if langs[i] != langs[lo]), len(langs))
        keys = [p.encode() for p in phrases[lo:hi]]
        data = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
        size = np.array(list(map(len, keys)), np.int64)
        start = np.cumsum(size) - size
        d = DoubleArray.of(data, start, size)
        short = np.maximum(8 - size, 0).astype(np.uint64) * np.uint64(8)  # bits behind the end of a short key
        open_ = np.where(short < 64, (np.uint64(1) << np.minimum(short, np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        first = _first_bytes(data, start)
        ends = _signed(np.array([(first & ~open_).min(), (first | open_).max()], np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 20 | k]), pa.array([langs[lo]]), pa.array([ends[0]]), pa.array([ends[1]]), pa.array([len(d.base)]), pa.array([d.base.astype("<i4").tobytes()]), pa.array([d.check.astype("<i4").tobytes()]), pa.array([phrases[lo:hi]], pa.list_(pa.string()))],
            names=[x.split()[0] for x in TRIES.split(", ")],
        )
        lo, k = hi, k + 1


def _counts(texts: DataFrame, bc) -> DataFrame:
    """(shard, node, counts): how often each key of each trie occurs in the texts of a task."""

    def run(batches):
        from pyspark import TaskContext

        by_lang: dict[str, list] = {}
        for r in bc.value:
            d = DoubleArray(np.frombuffer(r["base"], "<i4"), np.frombuffer(r["check"], "<i4"), r["n"])
            lo, hi = np.array([r["lo"], r["hi"]], np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            by_lang.setdefault(r["lang"], []).append((r["trie"], lo, hi, d, np.zeros(r["n"], np.int64)))
        for words in _buffers(batches):
            text = np.concatenate([words.bytes, np.full(8, 10, np.uint8)])
            for code, lang in enumerate(words.langs):
                if lang not in by_lang:
                    continue
                at = words.start[words.lang == code]
                first = _first_bytes(text, at)
                order = np.argsort(first)
                at, first = at[order], first[order]
                for _, lo, hi, d, total in by_lang[lang]:
                    own = at[np.searchsorted(first, lo, "left") : np.searchsorted(first, hi, "right")]
                    if len(own):
                        total += np.bincount(d.matches(text, own, _ENDS), minlength=len(total))
        node = TaskContext.get().partitionId()
        for trie, _, _, _, total in (x for tries in by_lang.values() for x in tries):
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([trie], pa.int64()), pa.array([node], pa.int32()), pa.array([total.astype("<i8").tobytes()])], names=["shard", "node", "counts"])

    return texts.mapInArrow(run, "shard long, node int, counts binary")


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all candidates and their words, exact; (lang, n) words by language)."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = {n: bits_for(words / 4 if n == 1 else words, hi=27) for n in range(1, MOST_WORDS + 1)}
    first = stored(_bounds(texts, (1,), bits, None, True))
    totals = stored(first.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"))
    maps = frequent(first.where("level = 1").select("level", "range", "buckets", "held"), {1: bits[1]}, LEAST)
    held = spark.sparkContext.broadcast(maps)
    for n in range(2, MOST_WORDS + 1):  # a level's bits keep most phrases of the next one out
        rows = _bounds(texts, (n,), bits, held, False).select("level", "range", "buckets", "held")
        maps |= frequent(rows, {n: bits[n]}, LEAST)
        held.unpersist()
        held = spark.sparkContext.broadcast(maps)
    found = stored(_emitted(texts, bits, held))
    held.unpersist()
    keys = found.select("lang", F.explode(F.concat(F.array("phrase"), F.split("phrase", " "))).alias("phrase")).distinct()
    keys = stored(keys)
    ranges = max(1, -(-keys.count() // TRIE_KEYS))
    tries = stored(keys.repartitionByRange(ranges, "lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(_trie_rows, TRIES))
    sums = None
    for group in in_groups(sorted((r["trie"], r["places"]) for r in tries.select("trie", "places").collect()), GROUP_PLACES):
        held_rows = [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in tries.where(F.col("trie").isin(group)).select("trie", "lang", "lo", "hi", "base", "check", F.size("phrases").alias("n")).toLocalIterator()]
        part = stored(_counts(texts, spark.sparkContext.broadcast(held_rows)))
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return spark.createDataFrame([], "lang string, phrase string, f long"), totals

    def named(batches):
        for b in batches:
            for lang_, phrases, counts in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(np.frombuffer(counts, "<i8"))], names=["lang", "phrase", "f"])

    total = tree_sum(sums).withColumnRenamed("shard", "trie")
    return tries.join(total, "trie").select("lang", "phrases", "counts").mapInArrow(named, "lang string, phrase string, f long"), totals


def score(counts: DataFrame, totals: DataFrame, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first candidates of each language."""
    counts = stored(counts.where(F.col("f") >= LEAST))
    words = F.split("phrase", " ")
    size = F.size(words)
    own = counts.where(size > 1).select("lang", "phrase", F.col("f").alias("a"))
    cut = own.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    both = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    both = both.withColumn("score", F.expr("cast(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"))
    worst = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    # runs of words inside a longer candidate
    inside = own.where(size > 2).withColumn("w", words).withColumn("m", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    longest = inside.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    left = worst.join(longest, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {INSIDE} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", first: int = FIRST) -> DataFrame:
    """The first collocations of each language."""
    return score(*counted(docs, text, lang), first)

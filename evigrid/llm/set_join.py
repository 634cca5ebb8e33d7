"""Similarity join of word-shingle sets by a token-group matrix (operator 13).

Sets are distinct ``WORDS``-word shingles as 64-bit hashes; two documents link when
``100 * common >= SHARE * union``.  Equal sets are one class, named by its least document id.

1. Order: shingles of often hit hash buckets come last, others by hash.  Alike sets share one of the
   first ``n - ceil(SHARE * n / 100) + 1`` shingles of each in any one order, the prefix.  All shingles are
   told apart so: texts that have much in common, but not enough, then meet in few cells.
2. Groups: classes with the same two least hashes (of the shingles and of a second permutation) are
   similar more often than not; a group has at most ``GROUP`` classes and ``GROUP_SHINGLES`` shingles.
3. The token-group matrix: (shingle, group) cells of the prefixes of a group's classes, with their sizes and
   the most shingles that any of them has from there on.  A query class meets the groups that have a cell in
   its own prefix, bounded by sizes and by what both still have behind the cell.
4. A pair of query and group that is left is bounded again on the group's whole union: the query must
   share ``SHARE`` percent of its own shingles with it.  Only groups that qualify are opened, and their
   classes confirmed on full sets.
5. First the classes of each group are compared, and in a few rounds each class asks the one group of a
   lesser component with which it shares most cells; then every class asks all groups that hold a class of a
   lesser component in its cells.
   Links inside one component need not be found, so no group of copies is squared; no other link is lost.

Results for odd input: texts without words (null, empty, blank) have empty sets and are linked with
nothing, as are rows with a null id; rows that repeat an id are one document and join its classes; ties
go to the least id; very long texts are whole sets; an empty table gives no rows; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.llm.bucket_filter import ROWS, Gathered, bits_for, frequent, passes
from evigrid.llm.chunks import buffered
from evigrid.llm.near_dup import components
from evigrid.llm.shingles import mix, shingles
from evigrid.session import ship, stored

WORDS, SHARE = 4, 85
GROUP, GROUP_SHINGLES = 64, 1 << 20
#: Least buckets a key where a bitmap picks texts: one in so many others passes by chance, and each is read to a whole set.
SPARSE = 64
#: Hits from which a bucket's shingles come last in the order, beside what the buckets are hit anyway once the space is full.
OFTEN = 12


def _sets(batches, words: int):
    """Lists of sets of a few MB of texts, with their keys."""
    for held in buffered(batches, 1):
        yield [k for b in held for k in b.column(0).to_pylist()], [shingles(t.as_py(), words) for b in held for t in b.column(1)]


def hits_of_often(keys: float, bits: int) -> int:
    """Hits that tell a bucket of often hit shingles from one that many rare ones share (a bound of the order alone: no link depends on it)."""
    load = keys / (1 << bits)
    return int(min(OFTEN + load + 6 * np.sqrt(load), 127)) if load > 1 else OFTEN


def _often(texts: DataFrame, words: int, bits: int, least: int) -> np.ndarray:
    def run(batches):
        gathered = Gathered({0: bits}, least)
        for _, sets in _sets(batches, words):
            yield from gathered.put(0, mix(np.concatenate(sets)))
        yield from gathered.rest()

    return frequent(texts.mapInArrow(run, ROWS), {0: bits}, least)[0]


def prefix_size(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def _ordered(s: np.ndarray, often: np.ndarray, bits: int) -> np.ndarray:
    """The shingles of a set, sorted by hash, in the order of the join."""
    late = passes(often, mix(s), bits)
    return np.concatenate([s[~late], s[late]])


SIGNED = "key long, n long, d1 long, d2 long, home long, prefix array<long>"


def _digest(s: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """Size and a 128-bit digest of a set."""
    return len(s), s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s * (s | np.uint64(1)))


def _longs(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def signatures(texts: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """key, n shingles, digest halves, hash of the two least shingles, prefix."""
    keys = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = bits_for(keys)
    often = texts.sparkSession.sparkContext.broadcast(_often(texts, words, bits, hits_of_often(keys, bits)))
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches):
        bitmap = often.value
        for keys, sets in _sets(batches, words):
            rows = []
            for s in sets:
                if len(s):
                    second = mix(s ^ np.uint64(0x5851F42D4C957F2D)).min()
                    prefix = _ordered(s, bitmap, bits)[: prefix_size(len(s), share)]
                    rows.append((*_digest(s), s[0] ^ (second << np.uint64(1)), prefix.view(np.int64)))
                else:
                    rows.append((0, np.uint64(0), np.uint64(0), np.uint64(0), np.empty(0, np.int64)))
            n, d1, d2, home, prefix = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), *map(_longs, (d1, d2, home)), pa.array(prefix, pa.list_(pa.int64()))], names=names)

    return texts.mapInArrow(run, SIGNED)


def _marked(keys: DataFrame, n: int, least: int, room: int = 2) -> tuple[object, int]:
    """(broadcast bits, width) of the hash buckets that ``least`` of n keys (one column of longs, or arrays of them) hit; ``room`` buckets a key at least."""
    bits = bits_for(room * n)

    def run(batches):
        gathered = Gathered({0: bits}, least)
        for b in batches:
            c = b.column(0)
            c = c.flatten() if pa.types.is_list(c.type) else c
            yield from gathered.put(0, mix(c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        yield from gathered.rest()

    return keys.sparkSession.sparkContext.broadcast(frequent(keys.mapInArrow(run, ROWS), {0: bits}, least)[0]), bits


class _Full:
    """Full sets (node, shingles) of asked classes; a text is fetched once, whatever step asks for it.

    Texts are picked by a bitmap of hashed keys, so none is shuffled; the few others that it lets through are left out again.
    """

    def __init__(self, texts: DataFrame, classes: DataFrame, words: int, repeated: bool):
        self.texts, self.words, self.sets, self.repeated = texts, words, None, repeated
        self.reps = classes.select("node", F.col("rep").alias("key"))

    def of(self, nodes: DataFrame) -> DataFrame:
        """nodes: (node), distinct."""
        new = stored(self.reps.join(nodes if self.sets is None else nodes.join(self.sets.select("node"), "node", "left_anti"), "node", "left_semi"))
        n = new.count()
        if n or self.sets is None:
            made, few = self._made(*_marked(new.select("key"), n, 1, SPARSE)), n <= CLASSES_SENT
            if few or self.sets is not None:
                made = made.join(F.broadcast(new) if few else new, ["node", "key"], "left_semi")
            made = made.select("node", "shingles")
            made = stored(made.groupBy("node").agg(F.first("shingles").alias("shingles")) if self.repeated else made)
            self.sets = made if self.sets is None else self.sets.unionByName(made)
        return self.sets

    def _made(self, wanted, bits: int) -> DataFrame:
        words = self.words

        def run(batches):
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(passes(wanted.value, mix(keys.astype(np.int64).view(np.uint64)), bits)) if len(keys) else []
                if len(keep):
                    sets = [shingles(t.as_py(), words) for t in b.column(1).take(pa.array(keep))]
                    n, d1, d2 = zip(*map(_digest, sets))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(n, pa.int64()), _longs(d1), _longs(d2), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))], names=["key", "n", "d1", "d2", "shingles"])

        made = self.texts.where("key is not null").mapInArrow(run, "key long, n long, d1 long, d2 long, shingles array<long>")
        return made.where("n > 0").select(_node(), "key", "shingles")


def _node():
    """The name of a class."""
    return F.xxhash64("d1", "d2", "n").alias("node")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _open(share: int, inside: bool):
    """One group with its queries: (group, part, node, label, shingles) twice -> links (a, b).

    The group's union bounds each query first; with ``inside`` the group's own classes are compared, too.
    """

    def fits(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
            return False
        common = _common(x, y)
        return 100 * common >= share * (len(x) + len(y) - common)

    def run(key, queries: pa.Table, members: pa.Table) -> pa.Table:
        out = []
        (q_node, q_label), (m_node, m_label) = ([t.column(c).to_pylist() for c in ("node", "label")] for t in (queries, members))
        q_sets, m_sets = ([v.values.to_numpy() for v in t.column("shingles")] for t in (queries, members))
        if q_sets and m_sets:
            union = np.unique(np.concatenate(m_sets)) if len(m_sets) > 1 else m_sets[0]
            for a, label, s in zip(q_node, q_label, q_sets):
                if 100 * _common(s, union) >= share * len(s):
                    out += [(a, b) for b, other, t in zip(m_node, m_label, m_sets) if other != label and fits(s, t)]
        if inside and key[1].as_py() == 0:
            label = dict(zip(m_node, m_label))
            for i, (a, s) in enumerate(zip(m_node, m_sets)):
                for b, t in zip(m_node[:i], m_sets[:i]):
                    if label[a] != label[b] and fits(s, t):
                        out.append((a, b))
                        old, new = label[a], label[b]
                        label.update({k: new for k, v in label.items() if v == old})
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


#: Queries of one group that a task takes at once; classes under this many are sent to all tasks, more are joined.
QUERIES, CLASSES_SENT = 512, 500_000
#: Rounds of stars; what they leave apart is settled by the last step, so links do not depend on it.
STAR_ROUNDS = 1


class Matrix:
    """Groups of classes and their token-group matrix."""

    def __init__(self, signed: DataFrame, classes: DataFrame, full: _Full, share: int, repeated: bool):
        self.share, self.full = share, full
        home = classes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_SHINGLES)).alias("parts"))
        dealt = classes.join(home, "home").withColumn("group", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))))
        self.members = stored(dealt.select("group", "node", "n", F.col("rep").alias("key")))
        # a shingle of one class alone leads nowhere: most are told by a bitmap, the others by a count
        shared, bits = _marked(signed.select("prefix"), int(signed.agg(F.sum(F.size("prefix"))).first()[0] or 0), 2)

        def run(batches):
            for b in batches:
                tokens, size = b.column(1).flatten().to_numpy(), pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                keep = np.flatnonzero(passes(shared.value, mix(tokens.view(np.uint64)), bits))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[keep])), pa.array(tokens[keep]), b.column(2).take(pa.array(row[keep])), pa.array(at[keep].astype(np.int32))], names=["key", "token", "_node", "at"])

        each = signed.select("key", "prefix", _node().alias("_node")).mapInArrow(run, "key long, token long, _node long, at int")
        each = each.join(self.members.select("key", "node"), "key").where("node = _node").select("token", "node", "at")
        each = stored(each.distinct() if repeated else each)
        several = each.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        self.asked = stored(each.join(several, "token", "left_semi"))
        self.few = self.members.count() <= CLASSES_SENT

    def _named(self, labels: DataFrame) -> DataFrame:
        """(node, own group, n, label) of all classes, sent to all tasks while they are few."""
        rows = self.members.join(labels, "node", "left").select("node", F.col("group").alias("own"), "n", F.coalesce("label", "node").alias("label"))
        return F.broadcast(rows) if self.few else rows

    def stars(self, labels: DataFrame) -> DataFrame:
        """(node, group): each class asks the one group that it shares most cells with, among the groups that hold the least component of its shingles."""
        rows = self.asked.join(self._named(labels), "node")
        hubs = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.struct("label", "own")).alias("hub")).where("x < y").select("token", "x", F.col("hub.own").alias("group"))
        met = rows.join(hubs, "token").where("label <> x and own <> group").groupBy("node", "group", "n").agg(F.count(F.lit(1)).alias("shared"))
        # sets of one size share nearly half of their prefix; what shares less of it is left to the last step
        met = met.where(3 * F.col("shared") >= F.col("n") - F.ceil(self.share * F.col("n") / 100) + 1)
        return met.groupBy("node").agg(F.max_by("group", F.struct("shared", F.col("group").alias("g"))).alias("group"))

    def rest(self, labels: DataFrame) -> DataFrame:
        """(node, group): each class asks all groups that hold a class of a lesser component in its cells, so of two components one asks the other."""
        rows = self.asked.join(self._named(labels), "node").withColumn("rest", F.col("n") - F.col("at"))
        cells = rows.groupBy("token", F.col("own").alias("group")).agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.max("rest").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        mixed = cells.groupBy("token").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x < y").select("token")
        cells = cells.join(mixed, "token", "left_semi").drop("hi")
        meets = (F.col("lo") < F.col("label")) & (100 * F.col("largest") >= self.share * F.col("n")) & (100 * F.col("n") >= self.share * F.col("least"))
        # of the shingles that two alike sets share the first one has enough of both behind it
        # (an alike class has at least the share of the query's size)
        enough = (100 + self.share) * F.least("rest", "most") >= self.share * (F.col("n") + F.greatest("least", F.ceil(self.share * F.col("n") / 100)))
        return rows.join(cells, "token").where(meets & enough).select("node", "group").distinct()

    def links(self, pairs: DataFrame, labels: DataFrame, inside: bool) -> DataFrame:
        """Links of the pairs (node, group): each group with its queries is one task's share, many queries are several."""
        named = lambda rows: rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs = stored(pairs)
        asked = pairs.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        if inside:
            many = self.members.groupBy("group").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("group", F.lit(1).alias("parts"))
            asked = asked.unionByName(many).groupBy("group").agg(F.max("parts").alias("parts"))
        asked = stored(asked)
        inner = self.members.join(asked, "group").select("group", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        query = pairs.join(asked, "group").select("group", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
        sets = self.full.of(pairs.select("node").union(inner.select("node")).distinct())
        full = lambda rows: named(rows).join(sets, "node").select("group", "part", "node", "label", "shingles")
        other = full(inner).toDF("group_", "part_", "node", "label", "shingles")
        return stored(full(query).groupBy("group", "part").cogroup(other.groupBy("group_", "part_")).applyInArrow(_open(self.share, inside), "a long, b long"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One row per document row: key, n_shingles, component_id (the least id reachable by links)."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = stored(signatures(texts, words, share))
    held = signed.where("n > 0 and key is not null")
    classes = stored(held.groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"), F.first("home").alias("home")).withColumn("node", _node()))
    member = held.select("key", F.col("n").alias("n_shingles"), _node())
    # an id with several rows joins their classes
    several = stored(member.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("a"), F.max("node").alias("hi")).where("k > 1"))
    links = stored(several.where("a < hi").select("key", "a").join(member.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct())
    repeated = not several.isEmpty()
    matrix = Matrix(held, classes, _Full(texts, classes, words, repeated), share, repeated)
    labels = components(links) if repeated and not links.isEmpty() else spark.createDataFrame([], "node long, label long")
    for k in range(STAR_ROUNDS + 1):
        last = k == STAR_ROUNDS
        found = matrix.links(matrix.rest(labels) if last else matrix.stars(labels), labels, k == 0)
        if not found.isEmpty():
            labels = components(found, labels)
    # a component is named by its least document
    joined = classes.select("node", "rep").join(labels, "node")
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = classes.select("node", "rep").join(joined.join(least, "label").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    found = member.join(stored(named), "node").select("key", "n_shingles", "component_id")
    rest = signed.where("n = 0 or key is null").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    return found.unionByName(rest)

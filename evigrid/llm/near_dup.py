"""Near-duplicate groups by one-permutation MinHash (operator 6).

1. ``signatures``: one pass over whole texts gives each row the size and a 128-bit
   digest of its 5-word shingle set and its band keys (one permutation, optimal
   densification, ``BANDS`` bands of ``ROWS`` bins).
2. Equal sets become one class, named by its least document id; classes of any
   number of copies cost one row from here on.
3. Classes that share a band key meet in a bucket.  A bucket gives star-shaped
   edges only: its least class to each other one, so a bucket of n classes gives
   n - 1 candidate pairs, whatever n is.
4. Pairs are confirmed on their full sets: ``100 * common >= 75 * union``.
5. Where a bucket still holds several components, further rounds cut it by a
   second such bucket of the same classes (bands i and i + k) and place new stars
   inside; this is cheap and joins most of what a centre unlike its bucket left.
6. Buckets that are mixed even then are settled exactly: their classes are dealt
   into tiles of two blocks, and a tile tests all its pairs of different components.
   So every pair that shares a bucket is in one component or tested.
7. Confirmed links become components by rounds of contraction, each over the edges that the last one left.

Bands of 4 miss a pair at the similarity 0.75 with a chance of 5e-6.

Results for odd input: texts without words (null, empty, blank) have an empty set
and are linked with nothing; rows with a null id are linked with nothing and
kept; rows that repeat an id are one document, of which ``deduplicate`` keeps the
least text; ties go to the least id; very long texts are whole sets, and tiles of
settled buckets are cut by shingles as well as by classes; an empty table gives no
rows; other columns pass through ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.llm.shingles import BANDS, bands, shingles
from evigrid.session import ship, stored

SHARE = 75
#: Rounds of stars inside doubly shared buckets; what they leave mixed is settled pair by pair, so links do not depend on it.
STAR_ROUNDS = 4
#: Classes and shingles of a block; a task holds the sets of two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, digest halves d1 and d2, band keys (empty for empty sets)."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, d1, d2, keys = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(s * (s | np.uint64(1))).astype(np.int64)) if len(s) else 0)
                keys.append(bands(s) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["key", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [np.sort(shingles(t.as_py()).view(np.int64)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, shingles array<long>")


class _Sets:
    """Full shingle sets of the documents in candidate pairs; a text is fetched once, whatever round asks for it."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.docs, self.sets = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), None

    def of(self, ids: DataFrame) -> DataFrame:
        ids = stored(ids if self.sets is None else ids.join(self.sets.select("key"), "key", "left_anti"))
        if self.sets is None or not ids.isEmpty():
            new = stored(_sets(self.docs.join(ids, "key", "left_semi"), "key", "text"))
            self.sets = new if self.sets is None else self.sets.unionByName(new)
        return self.sets


def _confirm(pairs: DataFrame, held: _Sets) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; only texts of documents in pairs are read again.

    Sets meet and are compared row by row, so a task holds one pair at a time.
    """
    sets = held.of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("t"))
    # 100 * common >= SHARE * (s + t - common), with common named once
    alike = (100 + SHARE) * F.size(F.array_intersect("s", "t")) >= SHARE * (F.size("s") + F.size("t"))
    return pairs.join(right, "b").join(left, "a").where(alike).select("a", "b").distinct()


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): label is the least node reachable. edges: (a, b) in any direction; ``labels`` are those of earlier edges.

    Each round leads every node to the least of its neighbours, and on by doubled steps to a node without a lesser one;
    edges then hold between such nodes alone, and those inside one are gone, so all rounds together read
    a small multiple of the edges.  Nodes stay in tables throughout.
    """
    edges = _contracted(edges, labels)
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
        while True:
            new = stored(root.select("node", F.col("label").alias("via")).join(root.select(F.col("node").alias("via"), "label"), "via").select("node", "label", "via"))
            root = new.select("node", "label")
            if new.where("label < via").isEmpty():
                break
        edges = _contracted(edges, root)
        if labels is not None:
            moved = labels.join(root.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            root = stored(moved.unionByName(root.join(labels.select("node"), "node", "left_anti")))
        labels = root
    return labels


def _contracted(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Edges (a, b) with a < b between the labels of their ends, where these differ."""
    if labels is not None:
        for end in ("a", "b"):
            edges = edges.join(labels.select(F.col("node").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _size_fits():
    """Sets of too different sizes cannot be alike."""
    return 100 * F.least("n", "c.n") >= SHARE * F.greatest("n", "c.n")


def _stars(buckets: DataFrame) -> DataFrame:
    """(bucket, node, n, label) -> candidate pairs of different components, star-shaped in each bucket."""
    centre = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket", "c")
    return (
        buckets.join(centre, "bucket").where(F.col("label") != F.col("c.label"))
        .where(_size_fits())
        .select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    )


def _alike_in_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Links among the classes of one tile: pairs of different components that share no earlier band."""
    i, x, y = (int(rows[c].iloc[0]) for c in ("i", "x", "y"))
    node, n, label, block = (rows[c].to_numpy().copy() for c in ("node", "n", "label", "block"))
    keys = np.stack(rows["bands"].to_numpy())[:, :i]
    sets = [np.asarray(v, np.int64) for v in rows["shingles"]]
    found = []
    for a in np.flatnonzero(block == x):
        fits = (block == y) & (label != label[a]) & (100 * np.minimum(n, n[a]) >= SHARE * np.maximum(n, n[a]))
        if x == y:
            fits[: a + 1] = False
        at = np.flatnonzero(fits)
        at = at[~(keys[at] == keys[a]).any(1)]  # a pair is tested in the first band that it shares
        if not len(at):
            continue
        values, size = np.concatenate([sets[b] for b in at]), n[at]
        place = np.searchsorted(sets[a], values)
        place[place == len(sets[a])] = 0
        common = np.add.reduceat((sets[a][place] == values).astype(np.int64), np.cumsum(size) - size)
        for b in at[100 * common >= SHARE * (size + n[a] - common)]:
            if label[a] != label[b]:
                found.append((node[a], node[b]))
                label[label == label[b]] = label[a]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _rest(mixed: DataFrame, classes: DataFrame, held: _Sets) -> DataFrame:
    """All links (a, b) between components inside the mixed buckets (node, n, i, bucket, label), each tile a task's share."""
    size = mixed.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = mixed.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit("tile")), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    several = dealt.groupBy("bucket", "x", "y").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket", "x", "y")
    tiles = stored(dealt.join(several, ["bucket", "x", "y"], "left_semi").select("bucket", "i", "x", "y", "node", "n", "label", "block"))
    sets = held.of(tiles.select(F.col("node").alias("key")).distinct()).withColumnRenamed("key", "node")
    full = tiles.join(sets.join(classes.select("node", "bands"), "node"), "node")
    return full.groupBy("bucket", "x", "y").applyInPandas(_alike_in_tile, "a long, b long").distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: key, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    sig = stored(signatures(docs, key, text))
    full = sig.where("n_shingles > 0 and key is not null")
    classes = stored(full.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("key").alias("node"), F.first("bands").alias("bands")))
    members = full.select("key", "n_shingles", "d1", "d2").join(classes.select("node", "d1", "d2", F.col("n").alias("n_shingles")), ["d1", "d2", "n_shingles"])
    # an id with several texts joins their classes
    same = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a < hi").select("key", "a").join(members.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    held, same = _Sets(docs, key, text), stored(same.distinct())
    # classes in buckets of two or more, each with the bucket's least class
    each = classes.select("node", "n", F.posexplode("bands").alias("i", "bucket"))
    centre = each.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "c")
    shared = stored(each.join(centre, "bucket"))
    tested = stored(shared.where("node <> c.node").where(_size_fits()).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(same.union(_confirm(tested, held)))
    # bands whose bucket still holds several components; unrelated classes seldom have two
    named = _labelled(shared.select("node", "n", "i", "bucket"), labels)
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    wide = stored(named.join(mixed, "bucket", "left_semi").groupBy("node", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "bucket"))).alias("open")).where("size(open) > 1"))
    for k in range(1, STAR_ROUNDS):
        second = F.expr(f"explode(filter(transform(map_keys(open), i -> if(map_contains_key(open, (i + {k}) % {BANDS}), xxhash64(open[i], open[(i + {k}) % {BANDS}], i), null)), x -> x is not null))")
        pairs = stored(_stars(_labelled(wide.select("node", "n", second.alias("bucket")), labels)).join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs)
        found = stored(_confirm(pairs, held))
        if not found.isEmpty():
            labels = components(found, labels)
    # what is still mixed is settled pair by pair
    named = _labelled(shared.select("node", "n", "i", "bucket"), labels)
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    found = stored(_rest(stored(named.join(mixed, "bucket", "left_semi")), classes, held))
    if not found.isEmpty():
        labels = components(found, labels)
    named = members.select("key", "d1", "d2", "n_shingles", "node").join(labels.withColumnRenamed("label", "_label"), "node", "left").select("key", "n_shingles", F.coalesce("_label", "node").alias("component_id"))
    rest = sig.where("n_shingles = 0 or key is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return named.unionByName(rest).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs``; rows with a null id stay."""
    lost = groups(docs, key, text).where("not kept").select(F.col("key").alias("_lost")).distinct()
    left = docs.join(lost, docs[key].cast("long") == F.col("_lost"), "left_anti")
    twice = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_twice")).count().where("count > 1").select("_twice")
    once = left.join(twice, F.col(key) == F.col("_twice"), "left_anti")
    # of an id with several rows the one with the least text stays; partial minima, so a hot id is no task of its own
    row = F.struct(*(F.col(c) for c in docs.columns))
    order = F.struct(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.to_json(row).alias("_all"))
    several = left.join(twice, F.col(key) == F.col("_twice"), "left_semi").groupBy(F.col(key).alias("_key")).agg(F.min_by(row, order).alias("_doc"))
    return once.unionByName(several.select("_doc.*"))

"""Operator 13 against all pairs of sets."""

import random

import pytest

from evigrid.llm import set_join
from tests.llm.conftest import ODD

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, words=4, share=85):
    sets = []
    for i, t in rows:
        w = (t or "").translate(FOLD).encode().split()
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(find(i) if i is not None and s else i)) for i, s in sets)


def variants(n, seed, edits):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(8, 150))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, int(len(w) * edits)))):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 99999)}"
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


def passages():
    """Unlike texts that share one long passage, some of them hardly longer than it."""
    rng, passage = random.Random(5), " ".join(f"p{i}" for i in range(60))
    return [(90000 + i, " ".join(f"u{rng.randint(0, 99999)}" for _ in range(rng.randint(5, 80))) + " " + passage) for i in range(60)]


COPIES = [(1000 + i, "Exactly The same copy of this text here") for i in range(30)]
SEVERAL = [(5, "other text of the same id"), (6, "OTHER text of the same id"), (None, "no id at all in this row today")]


@pytest.mark.parametrize("rows, group", [(variants(200, 1, 0.05) + COPIES + passages(), 64), (variants(200, 2, 0.1), 4), (ODD + SEVERAL, 64)])
def test_set_join(spark, monkeypatch, rows, group):
    monkeypatch.setattr(set_join, "GROUP", group)
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, node int, home string, n int").repartition(4)
    assert sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in set_join.groups(docs).collect()) == brute(rows)


def test_set_join_of_documents(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    assert sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in set_join.groups(real).collect()) == brute(rows)
    assert set_join.groups(real.limit(0)).count() == 0


def test_near_copies_below_the_share_do_not_meet(spark, monkeypatch):
    rng, asked, links = random.Random(7), [], set_join.Matrix.links
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(80):
        w = list(base)
        for k in rng.sample(range(200), 12):
            w[k] = f"n{rng.randint(0, 10**9)}"
        rows.append((i + 1, " ".join(w)))

    def counted(self, pairs, labels, inside):
        asked.append(pairs.count())
        return links(self, pairs, labels, inside)

    monkeypatch.setattr(set_join.Matrix, "links", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in set_join.groups(docs).collect()) == brute(rows)
    assert sum(asked) < 2 * len(rows)  # and not with their square


def test_full_sets_of_asked_classes_alone(spark):
    rows = [(i, f"a b c {i // 2} d e f") for i in range(6000)]
    texts = spark.createDataFrame(rows, "key long, text string")
    signed = set_join.signatures(texts).where("n > 0")
    classes = set_join.stored(signed.groupBy("d1", "d2", "n").agg(set_join.F.min("key").alias("rep")).withColumn("node", set_join._node()))
    full, half = set_join._Full(texts, classes, set_join.WORDS, False), set_join.F.pmod("rep", set_join.F.lit(4)) == 0
    assert full.of(classes.where(half).select("node")).count() == 1500
    assert full.of(classes.select("node")).groupBy("node").count().where("count = 1").count() == 3000

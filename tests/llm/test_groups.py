"""Operators 4, 6, 10 and the pipeline against brute force."""

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from evigrid.llm import decontaminate, near_dup, shingles, warc
from evigrid.session import shared_dir
from tests.llm.conftest import ODD

FOLD = {c: c + 32 for c in range(65, 91)}


def brute_groups(rows):
    sets = []
    for i, t in rows:
        w = (t or "").translate(FOLD).encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(find(i) if i is not None and s else i)) for i, s in sets)


def variants(n, originals=True):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(8, 120))] for _ in range(12)]
    rows = [(-20 + k, " ".join(w)) for k, w in enumerate(base)] if originals else []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 99999)}"
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


def test_groups(make, odd):
    rows = variants(160) + [(1000 + i, "Exactly The same copy of this text here") for i in range(30)] + [(2000, "short one"), (2001, "SHORT one")]
    got = near_dup.groups(make(rows)).collect()
    assert sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.key == r.component_id) for r in got)
    odd_rows = near_dup.groups(odd).collect()
    assert sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in odd_rows) == brute_groups(ODD)
    assert near_dup.groups(odd.limit(0)).count() == 0


def test_groups_of_variants_alone(make):
    """Without their originals some variants hang on one other variant only; all links are found."""
    rows = variants(160, originals=False)
    got = sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in near_dup.groups(make(rows)).collect())
    assert got == brute_groups(rows)


def test_bucket_with_an_unlike_centre(make, monkeypatch):
    """Alike texts that meet in one bucket only, whose least member is unlike them; blocks smaller than the bucket too."""
    text = lambda i, k: " ".join(f"t{i}w{j}" for j in range(40)) + f" end{k}"
    rows = [(i * 10 + k, text(i, k)) for i in range(8) for k in range(3)] + [(0, "nothing like any of the others in this bucket at all")]
    rows = list({i: (i, t) for i, t in rows}.values())
    real = near_dup.signatures
    monkeypatch.setattr(near_dup, "signatures", lambda *a: real(*a).withColumn("bands", F.transform("bands", lambda x, i: F.when(i == 3, F.lit(7)).otherwise(F.xxhash64("key", i)))))
    for block in (256, 4):
        monkeypatch.setattr(near_dup, "BLOCK", block, raising=False)
        got = sorted((str(r.key), r.n_shingles, str(r.component_id)) for r in near_dup.groups(make(rows)).collect())
        assert got == brute_groups(rows)


def test_deduplicate(make):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None), (None, "x"), (4, "other words entirely in this text"), (4, "other words entirely in this text")]
    left = near_dup.deduplicate(make(rows).withColumnRenamed("source", "key")).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "4", "None"]


def test_densified_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    for size in (3, 20, 400):
        same = []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, size * 2, dtype=np.uint64)
            a, b = np.unique(x[: size + size // 2]), np.unique(x[size // 2 :])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same.append((shingles.signature(a) == shingles.signature(b)).mean() - j)
        assert abs(np.mean(same)) < 0.05


def test_warc(spark):
    pages = [(1, "http://a.example/x", "<p>one</p>"), (2, "/rel", "<p>one</p>"), (3, "http://b.example", None), (4, None, ""), (5, "http://c.example/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n é"), (6, "u", "x" * 100_000), (7, "v", "<p>one</p>")]
    pages += [(8, "w", "twice"), (8, "w", "twice"), (3, "w", "twice"), (9, "s", "same id"), (9, "s", "other text"), (None, "n", "no key")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    path = f"{shared_dir(spark)}/w"
    warc.write(df.repartition(3), path)
    found = warc.captures(warc.read(spark, path))
    assert all(r.request is not None and r.metadata is not None and r.response is not None for r in found.collect())
    got = [tuple(r) for r in warc.page_rows(found).collect()]
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i or 0, last.get(h or "", 0))
    want = []
    for i, _, h in pages:
        d = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        again = i is not None and last[h or ""] != i
        want.append((i, len((h or "").encode()), d, "revisit" if again else "response", last[h or ""] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(map(tuple, warc.page_rows(warc.captures(warc.read(spark, path, blocks=False))).collect()), key=str) == sorted(want, key=str)
    empty = f"{shared_dir(spark)}/w"
    warc.write(df.limit(0), empty)
    assert warc.captures(warc.read(spark, empty)).count() == 0


def test_warc_gzip_members():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]


def test_broken_archives():
    """What cannot be read is one record of the kind broken; the records before it stand."""
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for tail in (one[:20], one[:-6], one.replace(b": 3", b": x"), one.replace(b": 3", b": -3"), b"noise"):
        found = list(warc.parse(one + tail))
        assert found[0][1] == b"abc" and len(found) == 2 and found[1] == ({"warc-type": "broken"}, tail)
    assert [h["warc-type"] for h, _ in warc.parse(gzip.compress(one) + gzip.compress(one)[:40])] == ["metadata", "broken"]
    assert list(warc.parse(b"")) == [] and list(warc.parse(one + b"\r\n")) == [({"warc-type": "metadata", "content-length": "3"}, b"abc")]


def test_packs_of_records(spark, monkeypatch):
    """Archives are cut by bytes: a small limit gives many files, and a large page one of its own."""
    monkeypatch.setattr(warc, "PACK_BYTES", 5000)
    df = spark.createDataFrame([(i, "u", "x" * (9000 if i == 3 else i)) for i in range(40)], "page_id long, url string, html string").repartition(1)
    path = f"{shared_dir(spark)}/w"
    warc.write(df, path)
    assert len(spark.read.format("binaryFile").load(path).collect()) > 5
    assert warc.page_rows(warc.captures(warc.read(spark, path))).count() == 40


def brute_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark, make, odd, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(25)] + [(90, ""), (91, None), (92, "Same Item text"), (93, "same item, TEXT"), (None, "null item id here")]
    docs = []
    for i in range(120):
        t = [word() for _ in range(rng.randint(0, 80))]
        if i % 4 == 0:
            t[rng.randint(0, len(t)) :] = (rng.choice(items[:25])[1] or "").split()
        docs.append((i, " ".join(t)))
    docs += [(500, "x same ITEM text y same item-text"), (501, "null item id here"), *ODD]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, n, h, k, s, c) for i, n, h, k, s, c in brute_hits([(i, t) for i, t in docs], [("null" if i is None else i, t) for i, t in items])]
    for chunk, block in ((4 << 20, 1 << 20), (200, 300)):
        monkeypatch.setattr(decontaminate, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.report(make(docs), table).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert decontaminate.report(odd.limit(0), table).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(odd, table.limit(0)).collect())


def test_proximity(spark, make):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = make([(1, "gamma x alpha y beta"), (2, "alpha x x x x x x beta gamma"), (3, "alpha beta"), (4, "beta alpha gamma")])
    assert {r.doc_id for r in decontaminate.search(docs, items, slop=2).collect() if r.items} == {1, 4}


def test_one_index_for_many_test_sets(spark, make):
    """The index knows no test set; phrases and proximity are asked of it later."""
    docs = make([(1, "one two three four"), (2, "four three two one"), (3, None)])
    index = decontaminate.build_index(docs, f"{shared_dir(spark)}/index")
    ask = lambda text, **how: {r.doc_id for r in decontaminate.search_index(index, spark.createDataFrame([(1, text)], "item_id long, text string"), **how).collect() if r.items}
    assert ask("two three") == {1} and ask("three two") == {2} and ask("five") == set() and ask("three two", slop=0) == {1, 2}


def test_pipeline(spark, sf):
    import corpus_pipeline
    from evigrid.llm import toxicity

    docs, base, columns = spark.read.parquet(f"{sf}/documents.parquet"), shared_dir(spark), None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        columns = columns or before.columns
        assert name == "bpe" or docs.columns == columns
        if name == "toxicity":
            m = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in toxicity.score(before, m).where("predicted = 0").collect()}
        if name == "near_dup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {str(r.doc_id) for r in docs.collect()} == {c for i, _, c in brute_groups(rows)}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert {str(r.doc_id) for r in docs.collect()} == {i for i, _, _, _, _, c in brute_hits([(r.doc_id, r.text) for r in before.collect()], items) if not c}
        if name in ("pii", "bpe"):
            assert docs.count() == before.count()


def test_components_go_on_from_labels(spark):
    rng = np.random.default_rng(3)
    n = 400
    edges = [(i, i + 1) for i in range(100, 160)] + [(i + 1, i) for i in range(200, 230)] + rng.integers(0, n, (150, 2)).tolist()
    least = list(range(n))
    for _ in range(n):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    table = lambda rows: spark.createDataFrame([tuple(map(int, r)) for r in rows], "a long, b long")
    want = {x: least[x] for a, b in edges if a != b for x in (a, b)}
    whole = {r["node"]: r["label"] for r in near_dup.components(table(edges)).collect()}
    first = near_dup.components(table(edges[:70]))
    later = {r["node"]: r["label"] for r in near_dup.components(table(edges[70:]), first).collect()}
    assert whole == want and later == want
    # what is inside a component is no edge of a later round
    assert near_dup._contracted(table(edges), near_dup.components(table(edges))).isEmpty()

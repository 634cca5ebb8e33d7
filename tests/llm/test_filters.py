"""Operators 2, 3, 5, 8, 9 on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from evigrid.llm import kneser_ney, pii, quality_rules, sharding, toxicity
from tests.llm.conftest import ODD


def test_toxicity_learns_and_leaves_the_held_out(spark, make):
    text = lambda i: f"word{i % 7} filler{i % 5} " + ("vile stuff" if i % 3 == 0 else "kind stuff")
    docs = make([(i, text(i)) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    m = toxicity.train(docs, wrong)
    rows = toxicity.score(docs.withColumn("score", F.lit("old")), m).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id for r in docs.where(toxicity.held_out()).collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_toxicity_pairs(spark, make):
    """Both words alone are harmless; together they are not."""
    rows = [(i, ["alpha x", "beta x", "alpha beta x", "x y"][i % 4]) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 == 2)) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.train(make(rows), labels)
    s = {r.text: r.predicted for r in toxicity.score(make(rows[:4]), m).collect()}
    assert s["alpha beta x"] == 1 and s["x y"] == 0 and s["alpha x"] == 0 and s["beta x"] == 0


def test_toxicity_of_words_neutral_alone(spark, make):
    """Two words of the base rate each, toxic together; and two words of which exactly one makes a text toxic."""
    rng = random.Random(5)
    rows, y = [], []
    for i in range(12_000):
        a, b = rng.random() < 0.03, rng.random() < 0.03
        rows.append((i, " ".join(["plain"] + ["alpha"] * a + ["beta"] * b + [f"w{rng.randint(0, 300)}" for _ in range(6)])))
        y.append(int(rng.random() < 0.1 or (a and b)))
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    probe = [(1, "plain alpha beta"), (2, "plain alpha"), (3, "plain beta"), (4, "plain")]
    s = {r.doc_id: r.score for r in toxicity.score(make(probe), toxicity.train(make(rows), labels)).collect()}
    assert s[1] >= 0.5 and max(s[2], s[3], s[4]) < 0.4
    rows = [(i, " ".join(["plain"] + ["alpha"] * (i & 1) + ["beta"] * (i >> 1 & 1) + [f"w{rng.randint(0, 300)}" for _ in range(6)])) for i in range(2000)]
    labels = spark.createDataFrame([(i, (i & 1) ^ (i >> 1 & 1)) for i, _ in rows], "doc_id long, toxic int")
    s = {r.doc_id: r.predicted for r in toxicity.score(make(probe), toxicity.train(make(rows), labels)).collect()}
    assert s == {1: 0, 2: 1, 3: 1, 4: 0}


def test_toxicity_held_out_accuracy(spark):
    """On labels that were not learned from."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).select("toxic", "predicted").collect()
    hit, toxic, said = sum(r.toxic and r.predicted for r in rows), sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    assert hit >= 0.75 * toxic and hit >= 0.9 * said, (hit, toxic, said)


def test_toxicity_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, none)).collect()
    assert len(rows) == len(ODD) and all(abs(r.score - 0.25) < 1e-9 and r.predicted == 0 for r in rows)
    assert toxicity.score(odd.limit(0), toxicity.train(odd.limit(0), none)).count() == 0


def brute_perplexities(trusted, docs):
    """Interpolated modified Kneser-Ney over bytes, by the textbook: contexts and words as byte strings."""
    order = kneser_ney.ORDER
    grams = lambda t: [(b"\0" * (order - 1) + t.encode())[i : i + order] for i in range(len(t.encode()))]
    c = {order: collections.Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        c[k] = collections.Counter(g[1:] for g in c[k + 1])
    d, total, kinds = {}, {}, {}
    for k in c:
        n = [sum(v == i for v in c[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        d[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.05), 0.95 * i) for i in (1, 2, 3)]
        total[k], kinds[k] = collections.Counter(), collections.Counter()
        for g, v in c[k].items():
            total[k][g[:-1]] += v
            kinds[k][g[:-1], min(v, 3)] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        h = g[:-1]
        if not total[k][h]:
            return p(g[1:])
        off = sum(d[k][i - 1] * kinds[k][h, i] for i in (1, 2, 3))
        v = c[k][g]
        return (v - d[k][min(v, 3) - 1] if v else 0) / total[k][h] + off / total[k][h] * p(g[1:])

    return {i: math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) if t else None for i, t in docs}


def test_perplexity_both_ways_and_sums(spark, real):
    docs = real.limit(40)
    m = kneser_ney.train(docs.limit(25))
    a = {r.doc_id: r.perplexity for r in kneser_ney.score(docs, m).collect()}
    b = {r.doc_id: r.perplexity for r in kneser_ney.score(docs, m, table_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 3e-6 for k in a)
    want = brute_perplexities([r.text for r in docs.limit(25).collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert all(abs(a[k] - want[k]) < 1e-5 for k in a)
    # the probabilities of all bytes after a known context add up to one
    t = {(r.ord, r.key): r for r in m.where("logp is not null").collect()}
    g = {(r.ord, r.key): r.loggamma for r in m.where("loggamma is not null").collect()}

    def p(order, key):
        if order == 0:
            return 1 / 256
        if (order, key) in t:
            return math.exp(t[order, key].logp)
        return math.exp(g.get((order, key >> 8), 0.0)) * p(order - 1, key & ((1 << 8 * (order - 1)) - 1))

    ctx = next(k for o, k in g if o == kneser_ney.ORDER)
    assert abs(sum(p(kneser_ney.ORDER, (ctx << 8) | b) for b in range(256)) - 1) < 1e-6


def test_perplexity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    rows = kneser_ney.verdicts(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all((r.perplexity is None) == (r.n_bytes == 0) and (r.kept or r.n_bytes == 0 or r.threshold is not None) for r in rows)
    assert kneser_ney.verdicts(odd.limit(0), labels).count() == 0


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd, real, make):
    more = make([(1, "a b c d e a b c d e f"), (2, "x\nx\n\n \nx"), (3, "a a a a a a a"), (4, "#$ a|b <c>")])
    for docs in (odd, real, more):
        want = sorted((str(r.doc_id), *counts(r.text)) for r in docs.collect())
        got = quality_rules.verdicts(docs).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_outliers(make):
    clean = [(i, " ".join(f"word{(i * 7 + k * 13) % 97}" for k in range(60 + i % 40))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"w%%%{k}$$$" for k in range(80 + i))) for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(make(clean + junk)).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in junk)
    assert quality_rules.verdicts(make([])).count() == 0


def brute_distances(x):
    """Minimum covariance determinant of one group by concentration steps, with floors on what is left of each variance."""
    q = lambda v, share: np.quantile(np.floor(np.abs(v) * 1000 + 0.5) / 1000 * np.sign(v), share, axis=0)

    def factor(c):
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i):
                low[i, j] = (c[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
            low[i, i] = max(math.sqrt(max(c[i, i] - low[i, :i] @ low[i, :i], 0)), quality_rules.FLOORS[i])
        return low

    d2 = lambda m, low: (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
    m = q(x, 0.5)
    ends = []
    for m, c in ((m, np.diag((1.4826 * q(np.abs(x - m), 0.5)) ** 2)), (x.mean(0), np.cov(x.T, bias=True))):
        low = factor(c)
        for _ in range(quality_rules.STEPS):
            far = np.floor(np.log1p(d2(m, low)) * 1000 + 0.5) / 1000
            near = x[far <= np.quantile(far, quality_rules.CORE)]
            m, low = near.mean(0), factor(np.cov(near.T, bias=True))
        ends.append((np.log(np.diag(low)).sum(), m, low))
    _, m, low = min(ends, key=lambda e: e[0])
    return d2(m, low) / quality_rules.CONSISTENT


def test_quality_verdicts_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        lang, source = ("en", "big") if i % 2 else (("de", "mid") if i % 8 else (None, None))
        w = [f"w{rng.randint(0, 900)}" + "x" * rng.randint(0, 4) for _ in range(rng.randint(12, 300))]
        w = [x + "#" * (i % 50 == 3) + "$" * (i % 50 == 4) for x in w]
        text = " ".join(w[: len(w) // 2]) + ("\nsame line here" * (30 if i % 50 == 5 else rng.randint(0, 1))) + "\n" + " ".join(w)[: None if i % 50 == 6 else 0]
        rows.append((i, text, lang, source))
    got = {r.doc_id: r for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    groups = collections.defaultdict(list)
    for i, _, lang, source in rows:
        if not got[i].base_failed:
            groups[lang, source].append(i)
    assert [len(g) >= quality_rules.LEAST for g in groups.values()].count(True) == 2
    for g in groups.values():
        if len(g) < quality_rules.LEAST:
            assert all(got[i].kept and got[i].distance is None for i in g)
            continue
        rate = lambda n, r: math.sqrt(n / (r.n_words + 20.0))
        x = np.array([[math.log1p(r.n_words), (r.word_chars + 110) / (r.n_words + 20.0), rate(r.n_symbols, r), rate(r.n_dup_lines, r), rate(r.n_repeat_words, r)] for r in map(got.get, g)])
        for i, d in zip(g, brute_distances(x)):
            assert abs(got[i].distance - d) < 1e-3 * (1 + d) and (abs(d - quality_rules.CUTOFF) < 0.1 or got[i].kept == (d <= quality_rules.CUTOFF))
    assert sum(not r.kept and not r.base_failed for r in got.values()) >= 8


def test_one_moderate_outlier_in_each_statistic(make):
    clean = [(i, " ".join(f"word{(i * 7 + k * 13) % 97}" for k in range(60 + i % 40))) for i in range(200)]
    words = clean[0][1].split()
    odd = [
        (900, " ".join(x + "###" if k % 5 == 0 else x for k, x in enumerate(words))), (901, "\n".join(["three short words"] * 4 + [" ".join(words[:40])])),
        (902, " ".join(x * 3 for x in words)), (903, "\n".join(" ".join(f"z{i}q{k}" for k in range(80)) for i in range(60))),
    ]
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(make(clean + odd)).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in odd)


def test_surrogates(make):
    rows = [(1, "Mr. Smith met Mrs Jones. SHTI.06@MAIL5.EXAMPLE.COM or shti.06@mail5.example.com, 4111 1111 1111 1111"), (2, "card 4111111111111111 from 10.20.30.40. v4.0 in 2024, 3."), (3, None), (4, ""), (None, "+1 (017) 555-7713 +10175557713"), (5, "clean"), (5, "clean"), (6, "token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!!")]
    got = collections.defaultdict(list)
    for r in pii.replace(make(rows).withColumnRenamed("lang", "_row"), count="n").collect():
        got[r.doc_id].append(r)
    assert [len(got[i]) for i in (1, 2, 3, 4, None, 5, 6)] == [1, 1, 1, 1, 1, 2, 1]
    a, b = got[1][0].text, got[2][0].text
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+ met Mrs [A-Z][a-z]+\. [A-Z]{4}\.\d\d@[A-Z0-9]+\.[A-Z]+\.COM or [a-z]{4}\.\d\d@[a-z0-9]+\.[a-z]+\.com, \d{4} \d{4} \d{4} \d{4}", a)
    assert not any(x in a + b for x in ("Smith", "Jones", "shti", "SHTI", "4111 1111", "411111111111", "10.20.30.40"))
    mails = re.findall(r"\S+@\S+(?=,| or)", a)
    assert mails[0].lower() == mails[1].lower() and re.sub(r"\D", "", a[-19:]) == re.search(r"\d{16}", b)[0]
    digits = [int(x) for x in reversed(re.search(r"\d{16}", b)[0])]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert b.endswith("v4.0 in 2024, 3.") and got[5][0].text == "clean" and got[3][0].text is None and got[4][0].text == ""
    one, two = got[None][0].text[:17], got[None][0].text[18:]
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", one) and re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert re.fullmatch(r"token = \"[0-9A-F]{40}\"!!", got[6][0].text) and "9233A8" not in got[6][0].text


def test_surrogates_of_persons(spark, make):
    rows = [
        (1, "Mr John Smith met Ms Anna-Maria Lopez. Smith paid. ANNA-MARIA did not; smithy work."), (2, "MRS JONES and mr jones saw Mr. J. O'Brien and Herr von der Leyen."),
        (3, "Mr Иванов met г-жа Петрова. Иванов paid."), (4, "Dr Weber wrote. Nobody else."), (5, "Call 202 555 0143 or 0171 2345678, host 2001:db8::ff00:42:8329."), (6, "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432"),
        (7, "Mr Smith again, and 078-05-1120"),
    ]
    t = {r.doc_id: r.text for r in pii.replace(make(rows)).collect()}
    m = re.fullmatch(r"Mr ([A-Z][a-z]+) ([A-Z][a-z]+) met Ms ([A-Z][a-z]+) ([A-Z][a-z]+)\. ([A-Z][a-z]+) paid\. ([A-Z]+) did not; smithy work\.", t[1])
    assert m and m[2] == m[5] and m[3].upper() == m[6] and not {"John", "Smith", "Lopez"} & set(m.groups())
    assert re.match(r"Mr (\w+) again", t[7])[1] == m[2] and "078-05-1120" not in t[7] and re.search(r"\d{3}-\d{2}-\d{4}$", t[7])
    assert not re.search("jones|brien|leyen", t[2], re.I) and re.fullmatch(r"MRS [A-Z]+ and mr [a-z]+ saw Mr\. [A-Z]\. [A-Z]\w+ and Herr von der [A-Z][a-z]+\.", t[2])
    k = re.fullmatch(r"Mr ([А-Я][а-я]+) met г-жа ([А-Я][а-я]+)\. ([А-Я][а-я]+) paid\.", t[3])
    assert k and k[1] == k[3] != "Иванов" and k[2].endswith("а")
    assert re.fullmatch(r"Dr [A-Z][a-z]+ wrote\. Nobody else\.", t[4]) and "Weber" not in t[4]
    assert not re.search("0143|2345678|8329", t[5]) and re.fullmatch(r"Call \d{3} \d{3} \d{4} or 0\d{3} \d{7}, host [0-9a-f:]+\.", t[5])
    a, b = re.fullmatch(r"IBAN (.*) or (.*)", t[6]).groups()
    assert a.replace(" ", "") == b != "GB82WEST12345698765432" and int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1


def test_surrogates_on_real_texts(spark, make):
    """Whole-corpus properties: documents without finds are untouched, no found entity is left, equal entities agree everywhere."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = pii.replace(docs, count="n").join(docs.withColumnRenamed("text", "old"), "doc_id").collect()
    assert len(rows) == docs.count() and any(r.n for r in rows)
    mails, pairs = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"), {}
    for r in rows:
        assert (r.old == r.text) == (r.n == 0)
        old, new = mails.findall(r.old or ""), mails.findall(r.text or "")
        assert len(old) == len(new)
        for x, y in zip(old, new):
            assert x != y and pairs.setdefault(x.lower(), y.lower()) == y.lower()
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


def test_surrogates_stay_distinct(make):
    rows = [(i, f"mail {chr(97 + i % 26)}@{chr(97 + i // 26)}.de") for i in range(300)]
    texts = [r.text for r in pii.replace(make(rows)).collect()]
    assert len(set(texts)) == 300 and not set(texts) & {t for _, t in rows}


def test_shards(make, odd):
    docs = make([(i, "x" * (i % 50)) for i in range(2000)] + [(7, "y" * 30)] * 40 + [(9999, "z" * 5000)])
    rows = sharding.assign(docs, 1000).collect()
    assert len(rows) == 2041
    shard = collections.defaultdict(int)
    for r in rows:
        shard[r.depth, r.bucket, r.page] += r.bytes
    for r in rows:
        assert r.shard_bytes == shard[r.depth, r.bucket, r.page]
    assert all(n <= 1000 for (d, _, _), n in shard.items() if n != 5000) and sum(n > 1000 for n in shard.values()) == 1
    # only oversized buckets split: the parent of a shard is over the limit
    total = collections.Counter()
    for r in rows:
        for d in range(r.depth + 1 if r.depth < 60 else 60):
            total[d, r.bucket >> (r.depth - d)] += r.bytes
    assert all(total[r.depth - 1, r.bucket >> 1] > 1000 for r in rows if 0 < r.depth < 60)
    assert sharding.assign(odd, 1 << 20).count() == len(ODD) and sharding.assign(odd.limit(0), 10).count() == 0


def test_shards_written(spark, make):
    from evigrid.session import shared_dir

    out = sharding.write_shards(make([(i, "x" * 20) for i in range(100)] + [(None, "q")]), f"{shared_dir(spark)}/s", 300).collect()
    assert sum(r.rows for r in out) == 101 and all(r.bytes <= 300 for r in out)


def test_hot_key_in_strands(make, monkeypatch):
    """A hot id is dealt to several strands; every page stays under the limit and each row has its place."""
    monkeypatch.setattr(sharding, "STRAND_PAGES", 4)
    rows = sharding.assign(make([(7, "x" * (i % 90)) for i in range(900)] + [(None, "same")] * 400), 200).collect()
    shard = collections.Counter()
    for r in rows:
        shard[r.depth, r.bucket, r.page] += r.bytes
    assert len(rows) == 1300 and max(shard.values()) <= 200 and all(r.shard_bytes == shard[r.depth, r.bucket, r.page] for r in rows)
    assert len({r.page >> 32 for r in rows}) > 3


def test_shards_written_of_a_repeated_key(spark, make):
    """A third of the rows share an id, some have none: their pages stay under the limit, as assigned."""
    from evigrid.session import shared_dir

    docs = make([(7 if i % 3 == 0 else i, "x" * (10 + i % 20)) for i in range(150)] + [(None, "q" * 20)] * 30)
    out = sharding.write_shards(docs, f"{shared_dir(spark)}/s", 300).collect()
    assert sum(r.rows for r in out) == 180 and all(r.bytes <= 300 for r in out)

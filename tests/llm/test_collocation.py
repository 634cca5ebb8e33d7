"""Operator 12 against counts of all phrases, and the trie against plain search."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evigrid.llm import collocation
from evigrid.llm.double_array import DoubleArray

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, first=2000):
    by, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(FOLD)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                by[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in by.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        inside = {p for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) for p in [q[i : i + m]] if 100 * b >= 50 * found[p]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, r, n[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


RNG = random.Random(3)
TEXTS = [(None, None), ("en", ""), (None, " \n "), ("en", "a" * 5000 + " b " + "a" * 5000)] + [("en", "One\t two  Three. one two three, one! two")] * 12 + [(None, "x y z é 日本 \x01b c")] * 11
TEXTS += [("fr", "x y z")] * 9 + [("fr", "x y\nz x y")] * 5 + [("de", " ".join(RNG.choice("ab cd ef gh the an".split()) for _ in range(50))) for _ in range(40)]


@pytest.mark.parametrize("trie_keys, places, together", [(1 << 17, 1 << 24, 8 << 20), (500, 3000, 50000)])
def test_collocations(spark, real, monkeypatch, trie_keys, places, together):
    """One trie and many in groups; texts at once and in buffers; null languages, clashing columns, ties."""
    for name, value in (("TRIE_KEYS", trie_keys), ("GROUP_PLACES", places), ("TOGETHER", together)):
        monkeypatch.setattr(collocation, name, value)
    rows = TEXTS + [(r.lang, r.text) for r in real.collect()]
    docs = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(5)
    assert sorted(tuple(r) for r in collocation.mine(docs).collect()) == brute(rows)


def test_first_collocations_and_no_rows(spark):
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    assert sorted(tuple(r) for r in collocation.mine(docs, first=3).collect()) == brute(TEXTS, 3)
    assert collocation.mine(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc é\0", min_size=1, max_size=6).map(str.encode), max_size=60), st.text("abc é\0\n", max_size=200).map(lambda t: (t + "\n").encode()))
def test_double_array(keys, text):
    keys = sorted(keys)
    size = np.array(list(map(len, keys)), np.int64)
    d = DoubleArray.of(np.frombuffer(b"".join(keys) + b"x", np.uint8), np.cumsum(size) - size, size)
    ends = np.zeros(256, bool)
    ends[[10, 32]] = True
    got = collections.Counter(d.matches(np.frombuffer(text, np.uint8), np.arange(len(text)), ends).tolist())
    assert got == collections.Counter(i for i, k in enumerate(keys) for p in range(len(text) - len(k)) if text.startswith(k, p) and text[p + len(k)] in b"\n ")


def test_candidates_of_many_buffers_are_distinct(spark, monkeypatch):
    """Candidates of equal phrases in several buffers meet packed, each once, with no exchange of phrases behind it."""
    monkeypatch.setattr(collocation, "TOGETHER", 64)
    texts = spark.createDataFrame([(f"a b c d{i % 3}. a b\nA b é", ["en", "de"][i % 2]) for i in range(40)], "text string, lang string").repartition(4)
    rows = [tuple(r) for r in collocation._emitted(texts, {}, spark.sparkContext.broadcast({})).collect()]
    tails = ["a b", "b c", "a b c", "b é", "a b é", *(x for i in range(3) for x in (f"c d{i}", f"b c d{i}"))]
    assert len(rows) == len(set(rows))
    assert {(k, p.lower()) for k, p in rows} == {(k, p) for k in ("en", "de") for p in tails}

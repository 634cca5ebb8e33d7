"""Operator 11 against a plain alignment, token by token."""

import collections
import hashlib
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evigrid.llm import alignment
from evigrid.llm.bpe import printable_bytes
from evigrid.llm.perfect_hash import PerfectHash
from evigrid.session import stored

TEXTS = [
    (1, None), (2, ""), (3, " \n "), (4, "a" * 5000), (5, "same words here"), (5, "same words here"), (None, "no id <|endoftext|> <s> x"), (7, "é ß 日本 😀 <|endoftext|> x  y \t z"), (8, "a▁b c"),
    (9, "\nfoo bar\n baz "), (10, "x 's don't   b  c"), (11, "日本語のテキスト" * 50), (12, "ﬁ x\x00y \x1c z"), (13, " lead"), (14, "<0x41> \r\n q"), (15, "ab\n"), (16, "\x1cfoo"), (17, "aaaa " * 30 + "=====-----=====" * 40),
]


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def brute(rows, a, b):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two, stands = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), printable_bytes()
    one.encode_special_tokens = True
    found = []
    for k, t in rows:
        x, y = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        spelt_x = [bytes(stands[c] for c in one.id_to_token(i)) for i in x]
        spelt_y = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or not b"".join(spelt_x) == b"".join(spelt_y) == (" " + t).encode():
            found.append((k, [], []))
            continue
        ends_x, ends_y = list(accumulate(map(len, spelt_x))), list(accumulate(map(len, spelt_y)))
        groups, lo = [], 0
        for hi in sorted(set(ends_x) & set(ends_y)):
            groups.append(([i for i, e in zip(x, ends_x) if lo < e <= hi], [i for i, e in zip(y, ends_y) if lo < e <= hi]))
            lo = hi
        found.append((k, groups, [(p, q) for g, h in groups for p in g for q in h]))
    held = collections.Counter(p for _, _, links in found for p in set(links))
    top = collections.defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return sorted((
        str(k), sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(held[p] == top[p[0]] for p in links),
        sum(held[p] for p in links), hashlib.sha256(text(groups).encode()).hexdigest() if groups else "",
    ) for k, groups, links in found)


@pytest.mark.parametrize("group_keys, shard_keys, large", [(1 << 22, 1 << 17, 1024), (300, 100, 4)])
def test_alignment(spark, real, tokenizer, pieces, monkeypatch, group_keys, shard_keys, large):
    """One table of counts and several that documents pass in turn; clashing columns; odd texts."""
    for name, value in (("GROUP_KEYS", group_keys), ("SHARD_KEYS", shard_keys), ("LARGE", large), ("FAN", 2)):
        monkeypatch.setattr(alignment, name, value)
    rows = TEXTS + [(r.doc_id, r.text) for r in real.where("doc_id < 20").collect()]
    docs = spark.createDataFrame([(k, t, "key", 1, "g") for k, t in rows], "doc_id long, text string, key string, pair int, groups string").repartition(5)
    ids = stored(alignment.encode(docs, tokenizer, pieces))
    counts = alignment.pair_counts(ids, tokenizer, pieces)
    assert len(counts.groups) == 1 or group_keys == 300
    assert sorted((str(r[0]), *r[1:]) for r in alignment.align(ids, counts, tokenizer, pieces).collect()) == brute(rows, tokenizer, pieces)


def test_alignment_parts(spark, tokenizer, pieces):
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello"), (3, None)], "doc_id long, text string")
    ids = stored(alignment.encode(docs, tokenizer, pieces))
    groups = {r.key: r.groups for r in alignment.groups(ids, tokenizer, pieces).collect()}
    assert len(groups[1]) == 2 and groups[3] == [] and groups[2][0] == groups[1][0]
    pairs = {(r.a, r.b): r.documents for r in alignment.pair_counts(ids, tokenizer, pieces).pairs().collect()}
    assert pairs[groups[2][0].a[0], groups[2][0].b[0]] == 2 and set(pairs.values()) == {1, 2}
    none = stored(alignment.encode(docs.limit(0), tokenizer, pieces))
    assert alignment.align(none, alignment.pair_counts(none, tokenizer, pieces), tokenizer, pieces).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), max_size=2000))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    h = PerfectHash.of(keys)
    assert sorted(h.number(keys)) == list(range(len(keys))) and (h.find(keys) == h.number(keys)).all()
    assert (h.find(keys[::2] ^ np.int64(1 << 62 | 5)) < len(keys)).all()
    other = np.setdiff1d(np.arange(500), keys)
    assert (h.find(other) == -1).all()

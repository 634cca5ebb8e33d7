"""Operators 1 and 7 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from evigrid.llm import bpe, chunks, token_file
from evigrid.session import shared_dir
from tests.llm.conftest import ODD


def test_automaton_equals_the_library(tokenizer):
    t = Tokenizer.from_file(tokenizer)
    a, table = bpe.automaton(tokenizer)
    rng = random.Random(3)
    parts = ["a", "aa", " ", "  ", "\n", "\t", " \n ", "é", "日本", "😀", "'s", "'ll", "12", "!!", "<|endoftext|>", "\x1c", "\x85", " ", "the", "ing", "--", "\x00", "hello world"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a" * 3000 + " " + "ab" * 2000]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    ids = lambda found: [np.frombuffer(x, bpe.IDS).tolist() for x in found]
    assert ids(chunks.values(texts, table)) == want
    assert ids(b"".join(table.entries(x)) for x in texts) == want
    assert ids(chunks.values([None, "", *texts[:3]], table)) == [[], [], *want[:3]]
    assert [a.decode(x) for x in want] == [t.decode(x, skip_special_tokens=False) for x in want]


def test_pieces_with_one_hash(tokenizer, monkeypatch):
    """Texts are told apart by their bytes even if all hashes agree."""
    t = Tokenizer.from_file(tokenizer)
    _, table = bpe.automaton(tokenizer)
    monkeypatch.setattr(chunks, "_piece_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["one two three", "four five", "six"]
    assert [np.frombuffer(x, bpe.IDS).tolist() for x in chunks.values(texts, table)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_round_trip_rows(spark, odd, tokenizer):
    t = Tokenizer.from_file(tokenizer)
    rows = bpe.round_trip(odd.withColumnRenamed("source", "n_tokens_"), tokenizer, keep=("lang", "absent"), ids="ids").collect()
    assert len(rows) == len(ODD)
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids, hashlib.sha256((x or "").encode()).hexdigest()) for i, x in ODD)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded_sha256) for r in rows) == want
    assert bpe.round_trip(odd.limit(0), tokenizer).count() == 0


def test_encode_then_decode(odd, tokenizer):
    back = bpe.decode(bpe.encode(odd, tokenizer), tokenizer).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(i), x or "") for i, x in ODD)


def test_token_file(spark, odd, real, tokenizer):
    t = Tokenizer.from_file(tokenizer)
    for docs in (odd, real):
        path = f"{shared_dir(spark)}/f"
        token_file.write(docs, path, tokenizer, parts=3)
        rows = docs.select("doc_id", "text").collect()
        start, got = 0, sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in token_file.read_digests(spark, path).collect())
        assert len(got) == len(rows)
        for (s, _, n, c), r in zip(got, sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))):
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            assert (s, n, c) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += n
    one = token_file.read_document(spark, path, 17).collect()
    assert len(one) == 1 and list(one[0].ids)[:-1] == t.encode(real.where("doc_id = 17").first().text, add_special_tokens=False).ids


def test_token_file_without_rows(spark, odd, tokenizer):
    path = f"{shared_dir(spark)}/f"
    token_file.write(odd.limit(0), path, tokenizer)
    assert token_file.read_digests(spark, path).count() == 0


def test_a_word_is_encoded_once(tokenizer, monkeypatch):
    """Signs and line ends about a word do not send it through the model again, and the ids are those of the library."""
    import tokenizers

    library, asked = Tokenizer.from_file(tokenizer), []

    class Model:
        def tokenize(self, w):
            asked.append(w)
            return library.model.tokenize(w)

    class Counting:
        model = Model()

        def __getattr__(self, name):
            return getattr(library, name)

    class Source:
        from_file = staticmethod(lambda path: Counting())

    monkeypatch.setattr(tokenizers, "Tokenizer", Source)
    monkeypatch.setattr(token_file, "_loaded", {})
    monkeypatch.setattr(token_file.gc, "freeze", lambda: None)
    every, kind = token_file.encoder(tokenizer)
    asked.clear()
    texts = ["on haheth on haheth, so haheth. so haheth$$$ it haheth.\nThe end haheth.\nThe", "é haheth, émile? émile.\nThe <|endoftext|> haheth,", "haheth, haheth"]
    got = [np.frombuffer(x, kind).tolist() for x in every(texts)]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert asked.count("\u0120haheth") == 1


def test_words_are_cut_from_signs_and_line_ends(tokenizer):
    t, every = Tokenizer.from_file(tokenizer), token_file.encoder(tokenizer)
    rng = random.Random(9)
    parts = [*".,;:!?'\"*#$%&<>|_-", "a", "The", "it's", "'ll", "n't", "\n", "\n\n", "\r\n", " ", " ", " ", "\t", "1", "é", "ß", "日", "\xa0", "\x7f", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [x + "<|endoftext|>," for x in texts[:20]]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for lo in range(0, len(texts), 500):
        assert [np.frombuffer(x, every[1]).tolist() for x in every[0](texts[lo : lo + 500])] == want[lo : lo + 500]


def test_a_word_is_looked_up_once_whatever_signs_stand_about_it():
    seen = []
    table = chunks.PieceTable(lambda x: seen.append(x) or x.encode(), ("<|endoftext|>",), 1000)
    words, signs = [f"w{chr(97 + i)}" for i in range(20)], ["", ".", ",", "***", "$$$", ".\nThe"]
    texts = [" ".join(w + s for w in words for s in signs)] * 2
    assert chunks.values(texts, table, True) == [x.encode() for x in texts]
    assert len(seen) < len(words) + len(signs) + 5

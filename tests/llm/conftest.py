import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns filled in."""

    def docs(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOC)

    return docs


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a" * 5000), (5, "same words here now and then again"), (5, "same words here now and then again"), (None, "no id at all in this row today"), (7, "é ß 日本 😀 <|endoftext|> x  y \t z")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)

import pytest

#: Null, empty, blank, short, repeated and very long texts, repeated and null ids, and columns whose names clash with those operators use.
TEXTS = [(1, "The quick brown fox jumps over the lazy dog again and again."), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "two words"), (7, "The quick brown fox jumps over the lazy dog again and again."), (7, "The quick brown fox jumps over the lazy dog again and again."), (None, "no id here at all"), (None, None), (8, "word " * 60_000), (9, "x" * 100_000), (10, "ñandú ünïcödé \U0001f600 text!")]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if t else None, "k", 1, 2, "m") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, block long, score long, row string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

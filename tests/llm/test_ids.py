"""An id column of text, where some ids are no numbers: those become null (no part in a search)."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cardsieve.llm import additive_quant, hilbert_pack, license_scan, pii, token_files, warc_index

ROWS = [("1", "mail a.b@example.org now"), (" 2 ", "two words"), ("x7", "mail c.d@example.org now"), ("", "four"), (None, "five"), ("9" * 25, "six")]


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i))


def test_documents(named):
    want = [None, None, None, None, 1, 2]
    assert ids(pii.find(named)) == want and pii.find(named).agg(F.sum("n_email")).first()[0] == 2
    assert ids(license_scan.scan(named)) == want
    files = token_files.write_files(named, public_tokenizers.path("byte_bpe_50k.json"), 50257)
    assert ids(token_files.read_files(*files)) == want
    pieces = hilbert_pack.pack(named, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert set(ids(pieces)) == {None, 1, 2} and pieces.filter("start = 0").count() >= 6


def test_pages(spark):
    long = "payload " * 200
    rows = [("5", "http://a.example/", long), ("x", "http://a.example/", long), ("7", "http://b.example/", long), (None, None, "short"), ("y", None, "short")]
    out = warc_index.archived(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=str) == sorted([(5, "revisit", 7), (None, "revisit", 7), (7, "response", None), (None, "response", None), (None, "response", None)], key=str)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(str(k) if k % 10 else f"v{k}", [float(x) for x in rng.normal(size=4)]) for k in range(1, 61)] + [("0", [1.0, 0.0, 0.0, 0.0])]
    out = additive_quant.search(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), every=20, k=5, books=2, size=8).collect()
    assert {r.query_id for r in out} == {0} and len(out) == 5 and all(r.vec_id % 10 for r in out)

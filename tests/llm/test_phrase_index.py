import pytest
import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from cardsieve.llm import phrase_index, queries


def brute(docs, items, window=13):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, phrase in items:
            v = words(phrase)
            for s in range(max(1, len(v) - window + 1) if v else 0):
                part = v[s : s + window]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        named.add(str(item))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


DOCS = [(1, "A b c d e f g h i j k l m n o"), (2, "x a B, c! d e f g h i j k l m"), (3, "a b c"), (4, None), (5, ""), (6, "q r " * 50 + "a b c"), (None, "a b c"), (7, "a b a b a b c a b c"), (7, "a b a b a b c a b c"), (8, "é1 é2"), (9, "a b"), (10, "c")]
ITEMS = [(1, "a b c d e f g h i j k l m n"), (2, "a b c"), (3, None), (4, "!!"), (5, "É1 é1 é2"), (5, "é1 É2 "), (5, "é1 é2"), (30, "q r q r"), (None, "a b c")]


def test_equals_brute_force(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, [i for i in ITEMS if i[0] is not None])
    assert sorted((tuple(r) for r in phrase_index.contamination(docs, items).collect()), key=str) == want


def test_blocks_of_items_give_the_same(spark, docs, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(phrase_index.contamination(docs, items).collect())
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", 2000)
    assert sorted(phrase_index.contamination(docs, items).collect()) == want


def test_segments_do_not_matter(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = phrase_index.build_index(docs, 20_000)
    assert index.count() > 10
    a = phrase_index.find_phrases(index, items)
    b = phrase_index.find_phrases(phrase_index.build_index(docs), items)
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL["op8_phrase_index"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(tuple(r) for r in queries.op8_phrase_index(spark, sf).select(*names).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha " + "x " * 20 + "beta"), (4, None)], "doc_id long, text string")
    out = phrase_index.find_near(phrase_index.build_index(docs), [(9, "alpha beta"), (8, "nowhere"), (7, "")], slop=4)
    assert {(r.doc_id, r.query_id) for r in out.collect()} == {(1, 9), (2, 9)}


def test_clean_documents(odd, spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    out = phrase_index.clean_documents(odd, items)
    assert out.columns == odd.columns and out.count() == odd.count() - 3
    assert phrase_index.clean_documents(odd.filter("false"), items).count() == 0
    assert phrase_index.clean_documents(odd, items.filter("false")).count() == odd.count()
    assert phrase_index.contamination(odd, items).agg(F.sum("n_words")).first()[0] > 60_000


def test_rows_are_cleaned_by_their_own_text(spark):
    """Null ids don't save a contaminated row, and a clean row with its id stays."""
    item = " ".join(f"q{k}" for k in range(15))
    rows = [(None, item), (None, "nothing of it here"), (1, item), (1, "clean text under the same id"), (2, None)]
    out = phrase_index.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == ["doc_id", "text"] and sorted((tuple(r) for r in out.collect()), key=str) == sorted((rows[k] for k in (1, 3, 4)), key=str)


def test_null_items_hit_without_a_name(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (7, "c d"), (None, "f")], "item_id long, text string")
    got = {r.doc_id: r for r in phrase_index.find_phrases(phrase_index.build_index(docs), items).collect()}
    assert (got[1].hit_starts, got[1].hit_ends, got[1].items) == ([1], [4], [7, None])
    assert (got[2].hit_starts, got[2].items, got[3].items) == ([1], [None], [])


def test_blocks_of_items_change_nothing(docs, spark, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = phrase_index.build_index(docs)
    told = lambda df: sorted(map(str, df.collect()))
    one = told(phrase_index.find_phrases(index, items))
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", 4000)
    assert told(phrase_index.find_phrases(index, items)) == one


def test_slop_beyond_the_gap_is_refused(docs):
    with pytest.raises(ValueError):
        phrase_index.find_near(phrase_index.build_index(docs.limit(1)), [(1, "a b")], slop=phrase_index.GAP)

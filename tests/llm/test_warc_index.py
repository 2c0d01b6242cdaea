import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cardsieve.llm import warc_index


def check(rows, got):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    assert len(got) == len(rows)
    for r in got:
        html = dict(rows)[r.page_id]
        raw = (html or "").encode()
        keep = max(groups[raw]) if len(raw) >= 1000 else r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if keep == r.page_id else ("revisit", keep))


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    check([(r.page_id, r.html) for r in pages.collect()], warc_index.archived(pages).collect())


def test_copies_and_odd_urls(spark):
    big = "é" * 600
    rows = [(1, "http://a.b/", big), (2, "http://a.b/", big), (3, None, big), (4, "::bad::", None), (5, "http://[x", ""), (6, "http://a.b/", "small"), (7, "http://a.b/", "small"), (8, "http://A.B:80/?z&a#f", "x" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    check([(a, c) for a, _, c in rows], warc_index.archived(df).collect())
    assert warc_index.archived(df.filter("false")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    big = "z" * 2000
    df = spark.createDataFrame([(1, "http://a/", big), (1, "http://a/", big), (None, "http://a/", big), (None, "http://b/", "q")], "page_id long, url string, html string")
    out = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_index.archived(df).collect()), key=str)
    assert out == [(1, "response", None), (1, "response", None), (None, "response", None), (None, "revisit", 1)]


def test_look_up_by_key_alone(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 50}.example.com/p{i % 3}", f"page {i}") for i in range(5000)], "page_id long, url string, html string")
    captures, folder = warc_index.write_archives(df)
    index = warc_index.build_index(captures)
    ask = spark.createDataFrame([(warc_index.url_key("http://h7.example.com/p1"), None), ("nothing", None), ("com,example,h3)/p0", 53), ("com,example,h3)/p0", 3)], "key string, page_id long")
    found = warc_index.look_up(index, ask)
    want = {i for i in range(5000) if i % 50 == 7 and i % 3 == 1} | {3}
    assert {r.page_id for r in found.collect()} == want
    read = warc_index.read_captures(found, folder, with_payload=True).collect()
    assert {(r.page_id, bytes(r.payload)) for r in read} == {(i, f"page {i}".encode()) for i in want}


@pytest.mark.parametrize("url,key", [("http://www.Example.com/A?b=2&a=1#x", "com,example)/A?a=1&b=2"), ("https://x.org:8080", "org,x:8080)/"), (None, ""), ("plain", "plain")])
def test_url_key(url, key):
    assert warc_index.url_key(url) == key


def test_damage_is_seen():
    raw = warc_index.make_record(1, "http://a/", b"payload", hashlib.sha1(b"other").hexdigest(), None, False)
    with pytest.raises(ValueError):
        warc_index.read_record(raw)

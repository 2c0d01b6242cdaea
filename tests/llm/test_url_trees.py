import math
import re
from collections import Counter

import numpy as np
import pytest

from cardsieve.llm import url_trees

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def parse(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match("[^?#]*", rest[len(host) :]).group()
    fits = [(len(r), r, v) for r, v in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    return url, rest, host, path, rule, verdict


def judged(urls, spark):
    """Scores by trees grown on rows one by one, from the same definition as the operator's docstring."""
    parsed = [parse(u) for u in urls]
    labelled = [p for p in parsed if p[5]]
    blocked, n = sum(p[5] == "block" for p in labelled), len(labelled)
    wb, wa = n / (2 * blocked), n / (2 * (n - blocked))
    hashed = {}
    suffix = lambda host, k: ".".join(host.split(".")[-k:])
    names = sorted({suffix(p[2], k) for p in parsed for k in (1, 2, 3)})
    df = spark.createDataFrame([(x,) for x in names], "s string")
    for r in df.selectExpr("s", f"pmod(xxhash64(s), {url_trees.BUCKETS}) b").collect():
        hashed[r.s] = r.b
    stats = [Counter((hashed[suffix(p[2], k)], p[5]) for p in labelled) for k in (1, 2, 3)]

    def row(p):
        url, rest, host, path = p[:4]
        query = m.group(1) if (m := re.match(r"[^?#]*\?([^#]*)", rest)) else ""
        entropy = -sum(c / len(url) * math.log2(c / len(url)) for c in Counter(url).values()) if url else 0.0
        digits = lambda t: len(re.findall("[0-9]", t)) / len(t) if t else 0.0
        out = [len(url), len(host), len(path), len(query), len(re.findall("/[^/]", path)), len(re.findall("[^.]+", host)), host.count("-"), digits(url), digits(host), entropy, len(re.findall("[^&]+", query)), len(re.findall("%[0-9A-Fa-f]{2}", url))]
        for k in (1, 2, 3):
            b, a = (stats[k - 1][hashed[suffix(host, k)], v] for v in ("block", "allow"))
            out += [(b * wb + 10) / (b * wb + a * wa + 20), math.log1p(a + b)]
        return out

    x, y = np.array([row(p) for p in labelled], float), np.array([p[5] == "block" for p in labelled])
    edges = [np.unique(np.percentile(c, [100 * k / 16 for k in range(1, 16)])) for c in x.T]
    weight = np.where(y, round(wb * 256), round(wa * 256)) / 256
    margin, trees = np.zeros(n), []

    def grow(rows, g, h, depth):
        leaf = lambda r: 0.4 * g[r].sum() / (h[r].sum() + 1)
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        best, found = 1e-6, None
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = rows[x[rows, f] <= e]
                right = rows[x[rows, f] > e]
                if min(len(left), len(right)) >= 20 and (own := gain(left) + gain(right) - gain(rows)) > best + 1e-9:
                    best, found = own, (f, e, left, right)
        if depth == 0 or found is None:
            return leaf(rows)
        f, e, left, right = found
        return f, e, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1)

    def value(tree, r):
        while isinstance(tree, tuple):
            tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(12):
        p = np.floor(2**20 / (1 + np.exp(-margin)) + 0.5) / 2**20
        c = np.floor(p * (1 - p) * 2**20 + 0.5) / 2**20
        trees.append(grow(np.arange(n), weight * (y - p), weight * c, 3))
        margin = margin + [value(trees[-1], r) for r in x]
    return [1 / (1 + math.exp(-sum(value(t, row(p)) for t in trees))) for p in parsed]


def test_the_same_as_trees_grown_row_by_row(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url").collect()]
    rng = np.random.default_rng(2)
    rows += [(10_000 + k, f"http://{'www.' if k % 3 else ''}h{k % 40}.shop.{['com', 'net', 'org'][k % 3]}/{['en', 'fr', 'es', 'x-y'][int(rng.integers(4))]}/{int(rng.integers(10**6))}{'?a=1&b=%20' if k % 5 == 0 else ''}") for k in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_trees.judge(df).collect()}
    assert len(got) == len(rows)
    score = judged([u for _, u in rows], spark)
    for (i, u), s in zip(rows, score):
        _, _, host, path, rule, verdict = parse(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert (r.verdict, r.score) == (verdict, None)
        else:
            assert r.score == pytest.approx(s, abs=1e-6) and r.verdict == ("block" if s >= 0.5 else "allow")
    assert len({r.score for r in got.values() if r.rule is None}) > 3


def test_learns_what_lexical_features_tell(spark):
    """Labelled hosts of two kinds; hosts never seen are judged by their looks."""
    rules = [("block", f"x{k}-win-{k}{k}-cash.com", "/") for k in range(40)] + [("allow", f"paper{chr(97 + k % 26)}{chr(97 + k // 26)}.org", "/") for k in range(40)]
    rows = [(k, f"http://{host}{path}{n}") for k, (_, host, path) in enumerate(rules) for n in ("a", "b/c")] + [(1000, "http://y9-win-99-cash.info/a"), (1001, "http://paperzz.info/a")]
    out = {r.page_id: r.verdict for r in url_trees.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("page_id >= 1000").collect()}
    assert out == {1000: "block", 1001: "allow"}


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://a.example.com/en/", "http://a.example.com/EN/", "x://com", "x://com/", "x://xcom/", "http://net/es/?q#f", "http://n.NET?x=/es/", "http://b.net/fr", "http://b.net/fr/" + "9" * 50_000, "a://b://c.com/d", "http://ü.org/é?ü=%C3"]
    rows = [(k if k != 3 else None, u, "h", "p", "r", 1.0) for k, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, score double")
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in url_trees.judge(df).collect()), key=str)
    assert got == sorted(((i, *parse(u)[2:5]) for i, u, *_ in rows), key=str)
    one = url_trees.judge(df.filter("page_id in (9, 16)")).collect()
    assert {r.verdict for r in one} == {"allow"} and [r.score for r in one if r.rule is None] == [0.0, 0.0]
    assert {r.verdict for r in url_trees.judge(df.filter("page_id = 16")).collect()} == {"allow"}
    assert url_trees.judge(df.filter("false")).count() == 0

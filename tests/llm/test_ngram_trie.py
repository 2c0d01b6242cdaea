import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardsieve.llm import langid, ngram_trie
from cardsieve.llm.elias_fano import EliasFano


def train_mark():
    return ~langid.held_out("doc_id", 7, 2)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe in (3, 1000, 1 << 30, 1 << 60):
        for n in (0, 1, 9, 3000):
            v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
            built = EliasFano.build(v, universe)
            e = EliasFano(*(built[part] for part in EliasFano.PARTS))
            assert (e.access(np.arange(n)) == v).all()
            ask = np.concatenate([v, rng.integers(0, universe, 100, dtype=np.uint64)])
            at, equal = e.find(ask)
            assert (equal == np.isin(ask, v)).all() and (at[equal] == np.searchsorted(v, ask[equal])).all()


def model(rows, order, discount=0.75):
    low = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for _, text, train in rows:
        if train:
            w = [b"\n"] * (order - 1) + low(text)
            for k in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    counts[n][tuple(w[k - n + 1 : k])][w[k]] += 1
    total, kinds = sum(counts[1][()].values()), len(counts[1][()])

    def score(text):
        w, out, base = [b"\n"] * (order - 1) + low(text), 0.0, 0.0
        for k in range(order - 1, len(w)):
            p = (counts[1][()][w[k]] + 1) / (total + kinds + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                c = counts[n].get(tuple(w[k - n + 1 : k]))
                if c:
                    s = sum(c.values())
                    p = max(c[w[k]] - discount, 0) / s + discount * len(c) / s * p
            out += math.log10(p)
        own = w[order - 1 :]
        return len(own), sum(counts[1][()][x] > 0 for x in own), total, base, out

    return score


@pytest.mark.parametrize("order,size", [(2, 1 << 22), (3, 1 << 15)])
def test_scores_equal_brute_force(docs, order, size):
    rows = [tuple(r) for r in docs.select("doc_id", "text", train_mark()).collect()]
    score = model(rows, order)
    got = {r.doc_id: r for r in ngram_trie.score(docs, train_mark(), order, block_bytes=size).collect()}
    assert len(got) == len(rows)
    for doc_id, text, train in rows[:60]:
        n, known, total, base, s = score(text)
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (n, known, total, train)
        assert r.base_score == pytest.approx(base) and abs(r.score - s) <= 0.016 * (order - 1) * n


def test_held_out_text_is_better_than_the_base(docs):
    out = ngram_trie.score(docs, train_mark()).filter("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_odd_rows(odd, spark):
    out = ngram_trie.score(odd, F.col("doc_id").isNotNull()).collect()
    assert len(out) == odd.count()
    assert all(r.n_tokens == 1 for r in out if r.doc_id in (2, 3, 4)) and all(math.isfinite(r.score) for r in out)
    assert ngram_trie.score(odd.filter("false"), F.lit(True)).count() == 0
    none = ngram_trie.score(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(0) for r in none)


def test_frequent_contexts_are_split_without_change(spark):
    docs = spark.createDataFrame([(i, " ".join(f"the w{(i * 7 + k) % 400}" for k in range(60))) for i in range(200)], "doc_id long, text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.lit(True)).collect()]
    score = model(rows, 2)
    for r in ngram_trie.score(docs, F.lit(True), 2, block_bytes=4000).filter("doc_id < 5").collect():
        assert abs(r.score - score(rows[r.doc_id][1])[4]) <= 0.016 * r.n_tokens

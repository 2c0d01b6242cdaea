import numpy as np
import pytest

from cardsieve.llm import additive_quant


def test_recall_and_scores(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for r in additive_quant.search(table, books=8, size=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = table.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [k for k in np.lexsort((ids, -s)) if k != q][:20]
        own = sorted(got[ids[q]])
        assert [a for a, _, _ in own] == list(range(1, len(order) + 1))
        assert [(-c, b) for _, b, c in own] == sorted((-c, b) for _, b, c in own)
        for _, b, c in own:
            assert c == pytest.approx(s[np.flatnonzero(ids == b)[0]], abs=1e-12)
        hits, total = hits + len({b for _, b, _ in own} & set(ids[order])), total + len(order)
    assert hits / total >= 0.9


def test_beam_encoding_is_no_worse_than_greedy():
    x = np.random.default_rng(1).standard_normal((400, 16)).astype(np.float32)
    model = additive_quant.fit(x, 4, 32)
    error = [((x - model.decode(model.encode(x, b)[0])) ** 2).sum() for b in (1, 8)]
    assert error[1] <= error[0] and model.encode(x, 4)[1] == pytest.approx((model.decode(model.encode(x, 4)[0]) ** 2).sum(axis=1), rel=1e-4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "b"), (40, None, "c"), (60, [0.0, 0.0], "d"), (80, [nan, 1.0], "e"), (100, [inf, 1.0], "f"), (120, [None, 1.0], "g"), (None, [1.0, 1.0], "h"), (5, [1.0, 0.0], "i"), (5, [1.0, 0.0], "i"), (3, [0.5, 0.5], "j"), (140, [1.0], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid string")
    out = sorted(tuple(r) for r in additive_quant.search(df, books=2, size=4).collect())
    assert out == [(0, 1, 5, 1.0), (0, 2, 20, 1.0), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 5, 1.0), (20, 3, 3, 0.5)]
    assert additive_quant.search(df.filter("false")).count() == 0


def test_many_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(100)] + [(200 + i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    out = additive_quant.search(df, books=2, size=4, k=3).filter("query_id in (0, 40)").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 204), (0, 203), (0, 202), (40, 204), (40, 203), (40, 202)]

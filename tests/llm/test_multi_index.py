import numpy as np
import pytest

from cardsieve.llm import multi_index


def brute(rows, every=50, positives=5, negatives=3, relabel=True):
    """All scores of every anchor, in plain integers."""
    kept = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or not all(x is not None and np.isfinite(x) for x in vector):
            continue
        own = ((label + 1) % 10 if relabel and i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in vector])
        kept[i] = min(kept.get(i, own), own)
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, (other, y) in kept.items() if b != a)
        for s, b, _ in [r for r in scored if r[2] == label][:positives]:
            window = [r for r in scored if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s]
            out += [(a, b, k, c, -s, -t) for k, (t, c, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def found(df, **settings):
    return sorted(tuple(r)[:6] for r in multi_index.mine(df, **settings).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_the_same_as_all_scores(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert found(table) == brute(rows)
    # many shards, few words; and cells larger than a shard
    assert found(table, words=4, shard=7) == brute(rows)


def test_ties_copies_and_a_hot_cell(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.25, 0.0], i % 3) for i in range(300)] + [(300 + i, rng.standard_normal(4).round(2).tolist(), int(rng.integers(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(df, words=4, shard=16, every=25) == brute(rows, every=25)


def test_search_stops_once_certified(spark):
    rng = np.random.default_rng(5)
    centres = 4 * rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.05 * rng.standard_normal(16)).tolist(), (i // 20) % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    index = multi_index.MultiIndex(df, words=16, shard=4096)
    best = index.positives(index.rows.filter("id % 50 = 0").select("id", "label", "vector"), 5).collect()
    assert len(best) == 200 and max(r.looked for r in best) < 500  # of 1000 rows of the label


def test_large_components(spark):
    rows = [(i, [float(2**18 + i), float(-(2**18)), 1.0], i % 2) for i in range(0, 120, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(df, words=2) == brute(rows)
    rows = [(i, [float(2**20 + i), 3.0], i % 3) for i in range(0, 200, 5)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), words=2) == brute(rows)
    with pytest.raises(ValueError):
        found(spark.createDataFrame([(1, [1e300], 1)], "vec_id long, embedding array<double>, label int"))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.6, 0.1], 2), (2, [0.7, 0.1], 2), (3, [0.9, 0.0], 3), (50, [0.0, 0.0], 1), (100, [-1.0, 0.0], 5), (150, [0.5, 0.5], 9)]
    odd = [(4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (None, [1.0, 0.0], 2), (8, [1.0, 0.0], None)]
    schema = "vec_id long, embedding array<double>, label int, shard string, id int, cell string"
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in good + odd + [(9, [1.0], 2)]], schema)
    assert found(df, words=2) == brute(good)
    assert found(df.filter("false")) == []
    text = spark.createDataFrame([("0", [1.0], 1), ("1", [1.0], 1), ("x", [1.0], 2), ("2", [0.9], 2)], "vec_id string, embedding array<double>, label int")
    assert found(text, words=2) == brute([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)])

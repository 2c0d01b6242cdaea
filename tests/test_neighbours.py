"""Nearest rows by pivots against brute force, and how many pairs of blocks are looked at."""

import numpy as np
import pytest

from cardsieve.operators import neighbours


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, d[i]))[:k]:
            if np.isfinite(d[i, j]):
                out.add((int(ids[i]), int(ids[j]), round(float(d[i, j]), 9)))
    return out


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")


def found(df):
    return {(r.a, r.b, round(r.d, 9)) for r in df.collect()}


@pytest.mark.parametrize("block,pivots", [(40, 8), (7, 3), (5000, 4)])
def test_against_brute_force(spark, block, pivots):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (120, 4)), rng.normal(0, 0.05, (60, 4)) + 9, np.repeat([[5.0, 5, 5, 5]], 50, axis=0), [[50.0, 0, 0, 0]]])
    ids = rng.permutation(1000)[: len(x)]
    assert found(neighbours.nearest_rows(frame(spark, x, ids), "v", "id", 6, block, pivots)) == brute(x, ids, 6)


def test_blocks_are_ruled_out(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 50, (12, 6))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.5, (900, 6))
    ids = np.arange(900)
    rows = neighbours.pivot_blocks(frame(spark, x, ids), "v", "id", 5, 50, 16)
    blocks = rows.filter("low is not null").count()
    pairs = neighbours.block_pairs(rows).count()
    assert rows.count() == 900 and blocks >= 12
    assert pairs < 0.6 * blocks**2
    assert found(neighbours.nearest_rows(frame(spark, x, ids), "v", "id", 5, 50, 16)) == brute(x, ids, 5)


def test_few_rows_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0])], "id long, v array<double>")
    assert found(neighbours.nearest_rows(df, "v", "id", 3)) == {(1, 2, 5.0), (2, 1, 5.0)}
    assert neighbours.nearest_rows(df.filter("false"), "v", "id", 3).count() == 0

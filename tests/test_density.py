"""Density clusters against a version that compares all points."""

import math
import random

import pytest

from cardsieve.operators import density


def brute(points, eps, least):
    good = {i: p for i, p in points.items() if all(x is not None and math.isfinite(x) for x in p)}
    far = lambda a, b: sum((x - y) * (x - y) for x, y in zip(good[a], good[b]))
    near = {i: [j for j in good if far(i, j) <= eps * eps] for i in good}
    core = {i for i in good if len(near[i]) >= least}
    cluster, seen = {}, set()
    for i in sorted(core):
        if i in seen:
            continue
        todo = [i]
        seen.add(i)
        while todo:
            k = todo.pop()
            cluster[k] = i
            for j in near[k]:
                if j in core and j not in seen:
                    seen.add(j)
                    todo.append(j)
    for i in good:
        if i not in core:
            around = sorted((far(i, j), j) for j in near[i] if j in core)
            if around:
                cluster[i] = cluster[around[0][1]]
    return {i: (cluster.get(i), int(i in core)) for i in points}


def found(df, columns, eps, least):
    return {r.id: (r.cluster, r.is_core) for r in density.dbscan(df, "id", columns, eps, least).collect()}


@pytest.mark.parametrize("d, eps, least", [(1, 0.3, 4), (2, 0.5, 5), (3, 1.0, 6)])
def test_the_same_as_all_pairs(spark, d, eps, least):
    rng = random.Random(d)
    centres = [[rng.uniform(-8, 8) for _ in range(d)] for _ in range(6)]
    points = {i: tuple(round(c + rng.gauss(0, 0.6), 2) for c in rng.choice(centres)) for i in range(900)}
    points |= {900 + i: tuple(round(rng.uniform(-12, 12), 2) for _ in range(d)) for i in range(300)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], ", ".join(["id long", *[f"a{k} double" for k in range(d)]]))
    assert found(df, [f"a{k}" for k in range(d)], eps, least) == brute(points, eps, least)


def test_a_third_of_all_points_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 16)
    rng = random.Random(9)
    points = {i: (1.0 + rng.random() / 100, 1.0) for i in range(400)}
    # a chain of full cells, some just within eps of the next, some just beyond
    points |= {400 + i: (1.0 + (i % 8) * rng.choice([0.98, 1.0, 1.02]), rng.random() / 3) for i in range(600)}
    points |= {2000: (None, 1.0), 2001: (float("nan"), 1.0), 2002: (50.0, 50.0), 2003: (-0.0, -1e-9)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, a0 double, a1 double")
    assert found(df, ["a0", "a1"], 0.5, 10) == brute(points, 0.5, 10)
    assert found(df.filter("false"), ["a0", "a1"], 0.5, 10) == {}


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 400), (400, 450), (450, 500), (7, 7), (600, 600)]
    got = {r.node: r.root for r in density.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {400: 400, 450: 400, 500: 400}

"""What went wrong on large tables only: sums that depend on the order of rows, estimates that differ from reading to reading."""

import math
import os
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardsieve.operators import neighbours, profiles, quantiles, velocity


def half_up(values, digits):
    return float((sum(map(Decimal, values)) / len(values)).quantize(Decimal(1).scaleb(-digits), "ROUND_HALF_UP"))


@pytest.fixture(scope="module")
def cents():
    rng = random.Random(5)
    out = {}
    for merchant in range(300):  # means that end in a half of the fourth digit
        while (sum(own := [rng.randrange(100, 9_999_999) for _ in range(600)]) % 6) != 3:
            pass
        out[merchant] = [str(Decimal(c) / 100) for c in own]
    return out


def test_means_of_halves_round_up_in_any_order(spark, cents):
    rows = [(m, i, float(v)) for m, own in cents.items() for i, v in enumerate(own)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "merchant long, client long, amount double").withColumns({"ts": F.timestamp_seconds("client"), "fraud": F.lit(False)}).repartition(9)
    out = profiles.merchant_profile(df, ["merchant"], "ts", "amount", "client", F.col("fraud"))
    got = {r.merchant: r.m for r in out.select("merchant", F.round("mean", 4).alias("m")).collect()}
    assert got == {m: half_up(own, 4) for m, own in cents.items()}


@pytest.mark.parametrize("spread", [False, True])
def test_prior_means_of_halves_round_up(spark, cents, spread):
    rows = [(i, m, float(v)) for m, own in cents.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "i long, k long, x double").withColumns({"id": F.col("k") * 1000 + F.col("i"), "ts": F.timestamp_seconds("i")})
    out = velocity.prior_mean(df, "x", ["k"], "ts", "id", spread=spread).filter("i in (256, 512)")
    got = {(r.k, r.i): r.m for r in out.select("k", "i", F.round("prior_mean", 9).alias("m")).collect()}
    assert got == {(m, n): half_up(own[:n], 9) for m, own in cents.items() for n in (256, 512)}


def test_prior_means_of_other_amounts(spark):
    values = [1e300, 0.1, 1 / 3, None, -5.0, 1e12, 2.00005]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], "id long, k string, x double").withColumn("ts", F.timestamp_seconds("id"))
    got = {r.id: r.prior_mean for r in velocity.prior_mean(df, "x", ["k"], "ts", "id").collect()}
    for i in range(len(values)):
        own = [v for v in values[:i] if v is not None]
        assert got[i] == (pytest.approx(sum(own) / len(own)) if own else None)


def test_a_stream_whose_cuts_are_estimated_unsteadily(spark, sf, monkeypatch):
    real = F.percentile_approx
    unsteady = F.udf(lambda: int.from_bytes(os.urandom(4), "big") * 20, "long").asNondeterministic()

    def estimate(c, points):
        micros = F.array(*[real(F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else c, p) + unsteady() for p in points])
        return F.transform(micros, F.timestamp_micros) if isinstance(c, str) else micros

    monkeypatch.setattr(F, "percentile_approx", estimate)
    ids = [r.event_id for r in entry.queries()["velocity_on_a_stream"](spark, sf).select("event_id").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_only_the_bins_of_wanted_places_are_put_in_order(spark, monkeypatch):
    rng = random.Random(3)
    values = [round(rng.uniform(900, 105000), 2) for _ in range(4000)] + [-float(v) for v in range(1, 900)] + [0.0, -0.0, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(None if i % 3 else "g", v) for i, v in enumerate(values)], "g string, v double")
    seen, real = [], quantiles.placed
    monkeypatch.setattr(quantiles, "placed", lambda counts, *a: seen.append(counts.count()) or real(counts, *a))
    points = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.p for r in quantiles.group_percentiles(quantiles.value_counts(df, ["g"], "v"), ["g"], points, "p").collect()}
    assert set(got) == {None, "g"} and seen[0] < 300
    for g, p in got.items():
        own = sorted((0 if v == 0 else v for i, v in enumerate(values) if v is not None and (None if i % 3 else "g") == g), key=lambda v: (math.isnan(v), v))
        at = [q * (len(own) - 1) for q in points]
        want = [own[int(a)] if a == int(a) else (math.ceil(a) - a) * own[math.floor(a)] + (a - math.floor(a)) * own[math.ceil(a)] for a in at]
        assert p == pytest.approx(want, nan_ok=True)


def test_neighbours_of_far_and_equal_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(5, 8)), 12, axis=0), rng.normal(size=(60, 8)) * 1e-9 + 1e6, [[1e200] * 8, [-1e200] * 8]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest_rows(df, "v", "id", 7, block=24).orderBy("a", "d", "b").collect():
        got.setdefault(r.a, []).append((r.d, r.b))
    with np.errstate(over="ignore"):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i and np.isfinite(d[i, j]))[:7]
        assert got.get(i, []) == want


def test_a_group_of_blocks_gives_k_rows_for_each_row():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(640, 4))
    others = [(0.0, y[s : s + 40], np.arange(s, s + 40) + 1000) for s in range(0, 640, 40)]
    rows, ids, d = neighbours._near_of_block(x, np.arange(50), np.full(50, np.inf), others, 3)
    near = np.argsort(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), axis=1)[:, :3]
    assert len(rows) == 150 and (ids.reshape(50, 3) == near + 1000).all() and (rows == np.repeat(np.arange(50), 3)).all()

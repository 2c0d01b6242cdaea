"""Window features against plain loops over random rows with ties."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardsieve.operators import velocity

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(i, r.choice(["a", "b", "c", None]), T0 + timedelta(seconds=r.randrange(0, 2000) * 30), float(r.randrange(1, 9)), r.random() < 0.3, r.choice("xyz")) for i in range(400)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, amount double, bad boolean, place string")


def before(rows, row):
    return [o for o in rows if o[1] == row[1] and (o[2], o[0]) < (row[2], row[0])]


def test_velocity(df, rows):
    got = {r.id: r for r in velocity.velocity(df, ["key"], "ts", "id", "amount", {"5m": 300, "1h": 3600}).collect()}
    for row in rows:
        if row[1] is None:
            assert got[row[0]].n_5m is None and got[row[0]].sum_1h is None
            continue
        for name, s in (("5m", 300), ("1h", 3600)):
            own = [o for o in before(rows, row) if (row[2] - o[2]).total_seconds() <= s]
            assert got[row[0]][f"n_{name}"] == len(own)
            assert got[row[0]][f"sum_{name}"] == pytest.approx(sum(o[3] for o in own))


def test_velocity_grows_with_window(df):
    out = velocity.velocity(df, ["key"], "ts", "id")
    assert out.filter("n_2m > n_5m or n_5m > n_10m or n_10m > n_1h or n_1h > n_24h").count() == 0


def test_bucketed_velocity_is_the_same(df):
    a = velocity.velocity(df, ["key"], "ts", "id", None, {"w": 300}).select("id", "n_w")
    b = velocity.bucketed_velocity(df, ["key"], "ts", "id", 300).select("id", F.col("n_earlier").alias("n_w"))
    assert sorted(a.collect(), key=lambda r: r.id) == sorted(b.collect(), key=lambda r: r.id)


def test_since_last_and_denials(df, rows):
    out = velocity.denied_before(velocity.since_last(df, F.col("bad"), ["key"], "ts"), F.col("bad"), ["key"], "ts", 600)
    for r in out.filter("key is not null").collect():
        own = [o for o in rows if o[1] == r.key and o[4] and o[2] < r.ts]
        want = min(((r.ts - o[2]).total_seconds() / 60 for o in own), default=None)
        assert r.minutes_since_last == (None if want is None else pytest.approx(want))
        assert r.denied_before == sum((r.ts - o[2]).total_seconds() <= 600 for o in own)


def test_distinct_in_last(df, rows):
    got = {r.id: r.distinct_in_last for r in velocity.distinct_in_last(df, "place", ["key"], "ts", "id", 1800).collect()}
    for row in rows:
        if row[1] is not None:
            assert got[row[0]] == len({o[5] for o in before(rows, row) if (row[2] - o[2]).total_seconds() <= 1800})


def test_empty_and_single(spark, df):
    assert velocity.velocity(df.filter("false"), ["key"], "ts", "id").count() == 0
    one = velocity.sequence_features(df.filter("id = 0"), ["key"], "ts", "id").first()
    assert (one.visit, one.is_first, one.gap_minutes) == (1, 1, None)

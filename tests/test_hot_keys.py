"""Keys that hold a third of all rows: dealt over ranges or buckets, the same results as by brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardsieve.operators import quantiles, ranges, stats, tables, velocity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    out = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(60)}"
        # ties of seconds, and rows exactly a window apart
        at = start + timedelta(seconds=rng.choice([60, 300, 1]) * rng.randrange(3000), milliseconds=rng.choice([0, 0, 500]))
        out.append((i, key, at, rng.choice([None, 1.5, 2.25, 7.0]), rng.choice(["a", "b", "c", None]), rng.random() < 0.1))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, ts timestamp, amount double, place string, flag boolean").repartition(7)


def earlier(rows, r):
    return [q for q in rows if q[1] == r[1] and r[1] is not None and (q[2], q[0]) < (r[2], r[0])]


def seconds(t):
    return int(t.timestamp() // 1)


def test_windows_of_a_hot_key(df, rows):
    windows = {"7s": 7, "5m": 300, "1d": 86400}
    plain = velocity.velocity(df, ["key"], "ts", "id", "amount", windows)
    dealt = velocity.velocity(df, ["key"], "ts", "id", "amount", windows, hot_share=0.1, hot_rows=1)
    alone = velocity.bucket_totals_velocity(df, ["key"], "ts", "id", "amount", windows)
    assert ranges.hot_keys(df, ["key"], 0.1, 1) == [("hot",)] and ranges.hot_keys(df, ["key"], 0.9, 1) == []
    names = [f"{m}_{w}" for m in ("n", "sum") for w in windows]
    got = [{r.id: [r[n] for n in names] for r in out.select("id", *names).collect()} for out in (plain, dealt, alone)]
    for r in rows:
        # order within a second is by id
        own = [q for q in rows if r[1] is not None and q[1] == r[1] and (seconds(q[2]), q[0]) < (seconds(r[2]), r[0])]
        inside = [[q for q in own if seconds(q[2]) >= seconds(r[2]) - w] for w in windows.values()]
        want = [len(x) for x in inside] + [sum(q[3] or 0.0 for q in x) for x in inside] if r[1] else [None] * 6
        for one in got:
            assert one[r[0]] == pytest.approx(want)


def test_no_window_over_a_whole_hot_key(df):
    text = velocity.bucket_totals_velocity(df, ["key"], "ts", "id", "amount", {"5m": 300})._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in text.splitlines() if "Window [" in line or "+- Window" in line]
    assert over and all("__bucket" in line for line in over)


@pytest.mark.parametrize("spread", [False, True])
def test_looks_back_without_limit(df, rows, spread):
    out = velocity.sequence_features(df, ["key"], "ts", "id", spread=spread)
    out = velocity.prior_count(out, F.col("flag"), ["key"], "ts", "id", spread=spread)
    out = velocity.prior_mean(out, "amount", ["key"], "ts", "id", spread=spread)
    out = velocity.previous_flag(out, F.col("flag"), ["key"], "ts", "id", spread=spread)
    out = velocity.since_last(out, F.col("flag"), ["key"], "ts", spread=spread)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, own = got[r[0]], earlier(rows, r)
        if r[1] is None:
            assert (g.visit, g.gap_minutes, g.prior_count, g.prior_mean, g.previous_flag, g.minutes_since_last) == (None,) * 6
            continue
        last = max(own, key=lambda q: (q[2], q[0]), default=None)
        amounts = [q[3] for q in own if q[3] is not None]
        flagged = [q[2] for q in own if q[5] and q[2] < r[2]]
        assert g.visit == len(own) + 1 and g.is_first == (not own) and g.prior_count == sum(q[5] for q in own)
        assert g.gap_minutes == (pytest.approx((r[2] - last[2]).total_seconds() / 60) if last else None)
        assert g.previous_flag == (int(last[5]) if last else 0)
        assert g.prior_mean == (pytest.approx(sum(amounts) / len(amounts)) if amounts else None)
        assert g.minutes_since_last == (pytest.approx((r[2] - max(flagged)).total_seconds() / 60) if flagged else None)


@pytest.mark.parametrize("spread", [False, True])
def test_order_of_transactions(df, rows, spread):
    got = {r.id: (r.visit, r.lapse_class, r.count_class) for r in velocity.transaction_order(df, ["key"], "ts", "id", spread=spread).collect()}
    for r in rows:
        own = earlier(rows, r)
        n = sum(q[1] == r[1] for q in rows)
        last = max((q[2] for q in own), default=None)
        lapse = "first" if last is None else "short" if (r[2] - last).total_seconds() <= 180 else "long"
        assert got[r[0]] == ((len(own) + 1, lapse, "single" if n == 1 else "few" if n <= 3 else "many") if r[1] else (None,) * 3)


@pytest.mark.parametrize("spread", [False, True])
def test_distinct_values_of_a_window(df, rows, spread):
    out = velocity.distinct_in_last(df, "place", ["key"], "ts", "id", 600, spread=spread)
    assert "collect_list" not in (out._jdf.queryExecution().optimizedPlan().toString() if not spread else "")
    got = {r.id: r.distinct_in_last for r in out.collect()}
    for r in rows:
        own = {q[4] for q in rows if r[1] is not None and q[1] == r[1] and (seconds(q[2]), q[0]) < (seconds(r[2]), r[0]) and seconds(q[2]) >= seconds(r[2]) - 600 and q[4] is not None}
        assert got[r[0]] == (len(own) if r[1] else None)


@pytest.mark.parametrize("parts", [4, 200])
def test_running_numbers_of_written_rows(spark, sf, parts, tmp_path):
    li = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        tables.numbered(li.repartition(parts), ["l_shipdate", "l_quantity"]).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = spark.read.parquet(str(tmp_path / "out"))
    r = out.agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(r) == (600_000, 600_000, 1, 600_000)
    steps = out.join(out.select((F.col("number") + 1).alias("number"), F.struct("l_shipdate", "l_quantity").alias("before")), "number")
    assert steps.filter(F.struct("l_shipdate", "l_quantity") < F.col("before")).count() == 0


def test_numbers_of_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(1.0,)] * 50 + [(float(k % 7),) for k in range(60)], "x double")
    out = tables.numbered(df, ["x"], 10, 20, ranges=9).orderBy("number").collect()
    assert [r.number for r in out] == list(range(11, 124)) and [r.chunk for r in out] == [(k // 20) + 1 for k in range(113)]
    assert [r.x for r in out] == [None] * 3 + sorted(r.x for r in out if r.x is not None)
    assert tables.numbered(df.filter("false"), ["x"]).count() == 0


def test_percentiles_of_a_skewed_group(spark):
    rng = random.Random(1)
    data = [("hot", round(rng.gauss(0, 9), 2)) for _ in range(700)] + [(f"g{k % 5}", float(k % 4)) for k in range(60)] + [("none", None), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, v double")
    counts = quantiles.value_counts(df, ["g"], "v")
    got = {r.g: r.p for r in quantiles.group_percentiles(counts, ["g"], (0, 0.1, 0.5, 0.93, 1), "p").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.93, 1.0)))).alias("p")).collect() if r.p}
    assert got.keys() == want.keys()
    for g in got:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
    assert len({r["__range"] for r in ranges.with_range(counts, ["g", "x"]).filter("g = 'hot'").select("__range").collect()}) > 20


def test_a_score_that_half_of_all_rows_share(spark):
    rows = [(i, 0.5 if i % 2 else (i % 100) / 100, i % 9 == 0) for i in range(1000)]
    got = [(r.decile, r.n, r.frauds) for r in stats.decile_lift(spark.createDataFrame(rows, "id int, s double, f boolean"), "s", "id", F.col("f")).orderBy("decile").collect()]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == [(d + 1, 100, sum(r[2] for r in order[100 * d : 100 * d + 100])) for d in range(10)]

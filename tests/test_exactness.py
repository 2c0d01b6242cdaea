"""Percentiles, null keys, tails and tables against plain Python or Spark's own answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cardsieve.functions import text
from cardsieve.operators import attribution, cases, profiles, quantiles, velocity
from cardsieve.sources import medallion, schema


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [None, None], [], [5.0] * 900 + [float(k) for k in range(300)], [random.Random(1).random() for _ in range(2000)]])
def test_percentiles_equal_the_one_task_aggregate(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    points = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = quantiles.percentiles(df, "x", points).first()[0]
    want = df.agg(F.percentile("x", F.array(*map(F.lit, points)))).first()[0]
    assert got == (want or [None] * len(points))


def test_null_keys_get_nulls(spark):
    rows = [(1, "a", 10, 5.0, True), (2, "a", 20, 5.0, True), (3, None, 10, 5.0, True), (4, None, 11, 5.0, True)]
    df = spark.createDataFrame(rows, "id long, k string, s long, x double, f boolean").withColumn("ts", F.timestamp_seconds("s"))
    flag = F.col("f")
    made = {
        "visit": velocity.sequence_features(df, ["k"], "ts", "id"),
        "count_class": velocity.transaction_order(df, ["k"], "ts", "id"),
        "prior_count": velocity.prior_count(df, flag, ["k"], "ts", "id"),
        "prior_mean": velocity.prior_mean(df, "x", ["k"], "ts", "id"),
        "previous_flag": velocity.previous_flag(df, flag, ["k"], "ts", "id"),
        "flag_in_last": velocity.flag_in_last(df, flag, ["k"], "ts", "id"),
        "minutes_since_last": velocity.since_last(df, flag, ["k"], "ts"),
        "denied_before": velocity.denied_before(df, flag, ["k"], "ts"),
        "distinct_in_last": velocity.distinct_in_last(df, "x", ["k"], "ts", "id"),
        "is_double": profiles.double_charge(df, ["k"], "x", "ts", "id"),
        "n_24h": velocity.velocity(df, ["k"], "ts", "id"),
    }
    want = {"visit": 2, "count_class": "few", "prior_count": 1, "prior_mean": 5.0, "previous_flag": 1, "flag_in_last": 1, "minutes_since_last": 10 / 60, "denied_before": 1, "distinct_in_last": 1, "is_double": 1, "n_24h": 1}
    for name, out in made.items():
        got = {r.id: r[name] for r in out.collect()}
        assert len(got) == 4 and got[3] is None and got[4] is None, name
        assert got[2] == pytest.approx(want[name]) if isinstance(want[name], float) else got[2] == want[name], name


def test_chi_square_tail_has_no_overflow():
    def by_recurrence(x, dof):  # Q(k + 2) = Q(k) + term, in logarithms
        q = math.erfc(math.sqrt(x / 2)) if dof % 2 else math.exp(-x / 2)
        for k in range(2 - dof % 2, dof, 2):
            q += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        return q

    for x, dof in [(1500, 1400), (1500, 1401), (5000, 5000), (3.84, 1), (9.49, 4), (200, 999)]:
        assert attribution.chi2_tail(x, dof) == pytest.approx(by_recurrence(x, dof), rel=1e-9)
    assert attribution.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and attribution.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert attribution.chi2_tail(0, 7) == 1.0 and math.isnan(attribution.chi2_tail(1.0, 0))


def test_html_tables_with_open_cells_spans_and_inner_tables(spark):
    html = "<table><tr><th>Code<th colspan=2>Note</tr><tr><td>A<td>x<table><tr><td>inner</td></tr></table><td>y</tr><tr><td>B<td>z"
    rows = cases.html_table_rows(spark.createDataFrame([(1, html)], "p long, h string"), "p", "h", "code").collect()
    assert [(r.row, r.column, r.value) for r in rows] == [(0, "code", "A"), (0, "note", "x"), (0, "note", "y"), (1, "code", "B"), (1, "note", "z")]


def test_silver_takes_wider_types(spark, tmp_path):
    path = str(tmp_path / "silver")
    loads = [("2024-01-01", 1, "x"), ("2024-01-02", 2.5, "y"), ("2024-01-03", "many", "z")]
    for day, value, other in loads:
        medallion.append_silver(spark, spark.createDataFrame([(value, other)], ["v", "o"]), path, day)
    back = spark.read.option("mergeSchema", True).parquet(path)
    assert dict(back.dtypes)["v"] == "string" and sorted(r.v for r in back.collect()) == ["1.0", "2.5", "many"]
    medallion.append_silver(spark, spark.createDataFrame([(7, "w")], ["v", "o"]), path, "2024-01-04")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["1.0", "2.5", "7", "many"]


def test_cards_periods_and_segments(spark):
    df = spark.createDataFrame([(" 123456xxxxxx7890", "111222"), ("123456", None), (None, None), ("nan", "55")], "a string, b string")
    assert [r[0] for r in df.select(text.rebuild_card(F.col("a"), F.col("b"))).collect()] == ["1234561112227890", "123456", None, "55"]
    days = spark.createDataFrame([(1, "2024-01-01", "VISA"), (2, "2024-01-31", "4x"), (3, None, None), (4, "2024-02-01", "MC")], "i long, d string, s string")
    ids = lambda x: sorted(r.i for r in x.collect())
    assert ids(schema.filter_period(days, "d", "2024-01-01", "2024-01-31")) == [1, 2] and ids(schema.filter_period(days, "d", "2024-01-02")) == [2, 4]
    assert ids(schema.filter_segment(days, "s", ["MC"], ["4"])) == [2, 4] and ids(schema.filter_segment(days, "s")) == []

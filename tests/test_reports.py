"""Charge types, claims by dimension, logs with history, approvals by currency, card testing and mixed types on small frames."""

from datetime import datetime

from pyspark.sql import functions as F

from cardsieve.operators import profiles, tables
from cardsieve.sources import readers, schema


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_charge_types(spark):
    prices = [100.0] * 5 + [80.0] * 3 + [50.0] * 2
    catalogue = profiles.price_catalogue(spark.createDataFrame([(p,) for p in prices], "amount double"), "amount", 3)
    # 81.1 is 1.375 % off the second price: no known price, but maintenance; 300 and 302 are three months, 250 nothing
    amounts = [100.0, 100.9, 81.1, 79.2, 300.0, 302.0, 125.0, 149.99, 150.0, 250.0, None, 0.0, -100.0]
    own = spark.createDataFrame([(k, a, k != 11) for k, a in enumerate(amounts)], "id int, amount double, rec boolean")
    got = dict(rows(profiles.charge_types(own, "amount", catalogue, F.col("rec")), "id", "charge_type"))
    want = ["known_price", "known_price", "maintenance", "known_price", "months_3", "months_3", "addon", "addon", "unexplained", "unexplained", None, "other", "unexplained"]
    assert [got[k] for k in range(len(amounts))] == want
    months = dict(rows(profiles.charge_types(own, "amount", catalogue, F.col("rec")), "id", "n_months"))
    assert months[4] == 3 and months[0] == 1 and months[9] == 1
    none = profiles.charge_types(own, "amount", catalogue.limit(0), F.col("rec"))
    assert rows(none.filter("id in (0, 11, 10)"), "id", "charge_type") == {(0, "unexplained"), (11, "other"), (10, None)}


def test_bursts_and_usual_counts(spark):
    t = [datetime(2024, 1, 1, 0, m) for m in (0, 10, 20, 30)] + [datetime(2024, 1, 2, 0, 5), datetime(2024, 1, 1)]
    own = spark.createDataFrame([(k, "b" if k < 5 else None, t[k], 10.0 * k, k % 2) for k in range(6)], "id int, bin string, ts timestamp, amount double, client int")
    out = profiles.range_bursts(own, "bin", "ts", "id", "amount", "client", 3, 60.0, 2)
    assert rows(out, "id", "n_1h", "n_24h", "sum_24h", "clients_day", "is_burst", "is_large_amount", "is_many_clients") == {
        (0, 0, 0, 0.0, 2, 0, 0, 1), (1, 1, 1, 0.0, 2, 0, 0, 1), (2, 2, 2, 10.0, 2, 0, 0, 1), (3, 3, 3, 30.0, 2, 1, 0, 1), (4, 0, 3, 60.0, 1, 0, 1, 0), (5, None, None, None, 0, 0, 0, 0)}
    counted = spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("a", 2, None), (None, 1, 3), (None, 1, 2)], "m string, day int, n int")
    out = profiles.beyond_mean_count(counted, "n", ["m"], ["day"])
    assert sorted(map(tuple, out.select("m", "n", "mean_count", "is_beyond_mean_count").collect()), key=str) == sorted([("a", 5, 1.5, 1), ("a", 4, 1.5, 1), ("a", None, 1.5, 0), (None, 3, None, 1), (None, 2, None, 0)], key=str)


def test_summary_by_indicator(spark):
    own = spark.createDataFrame([("1", 10.0, "R"), ("1", 30.0, "N"), ("2", 5.0, None), ("2", None, "R")], "month string, amount double, i string")
    out = tables.summary_by_period(own, F.col("month"), "amount", F.col("i") == "R", "i", ["N", "R"])
    assert rows(out, "period", "n", "n_N", "amount_N", "ticket_N", "n_R", "amount_R", "ticket_R", "fraud_rate") == {("1", 2, 1, 30.0, 30.0, 1, 10.0, 10.0, 0.5), ("2", 2, 0, 0.0, 0.0, 1, 0.0, 0.0, 0.5), ("TOTAL", 4, 1, 30.0, 30.0, 2, 10.0, 10.0, 0.5)}


def test_log_of_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("0424", " a"), ("0424", "a"), ("0424", None), ("0622", "b"), (None, "a")], "code string, merchant string")
    second = spark.createDataFrame([("0424", "c")] * 2, "code string, merchant string")
    tables.log_counts(second, path, "24052026", "code", "merchant")
    tables.log_counts(first, path, "24052026", "code", "merchant")  # the day again
    tables.log_counts(second, path, "25052026", "code", "merchant")
    tables.log_counts(first.limit(0), path, "26052026", "code", "merchant")
    assert rows(tables.ranked_log(spark, path), "group", "item", "total", "days", "rank") == {("0424", "a", 2, 1, 1), ("0424", "c", 2, 1, 1), ("0424", "NO_VALUE", 1, 1, 2), ("0622", "b", 1, 1, 1)}


def test_claims_by(spark):
    own = spark.createDataFrame([("x", 1, 10.0, 1), ("x", 2, None, 4), ("y", 2, 5.0, None), (None, 2, 1.0, 2)], "channel string, mcc int, amount double, delay int")
    out = tables.claims_by(own, ["channel", "mcc"], "amount", "delay")
    assert rows(out, "dimension", "value", "n", "amount", "mean", "share", "median_delay") == {
        ("channel", "x", 1, 10.0, 10.0, 0.5, 2.5), ("channel", "y", 1, 5.0, 5.0, 0.25, None), ("mcc", "1", 1, 10.0, 10.0, 0.25, 1.0), ("mcc", "2", 2, 6.0, 3.0, 0.75, 3.0)}
    assert tables.claims_by(own.limit(0), ["channel", "mcc"], "amount", "delay").count() == 0


def test_amounts_by_currency(spark):
    own = spark.createDataFrame([("b", True, 40.0, 10.0, 40.0), ("b", True, 40.0, 10.0, 10.0), ("b", False, 8.0, 2.0, 2.0), ("b", None, 8.0, 2.0, None)], "bin string, ok boolean, local double, usd double, original double")
    own = own.withColumn("code", F.lit("59"))
    out = tables.approval_matrix(own, "bin", F.col("ok"), "code", "local", F.lit(False), original="original", currencies={"local": "local", "usd": "usd"})
    assert rows(out, "approved", "declined", "code_59", "approved_local", "declined_local", "approved_usd", "declined_usd") == {(2, 2, 4, 40.0, 0.0, 10.0, 2.0)}


def test_card_testing(spark):
    day = datetime(2024, 1, 1)
    own = spark.createDataFrame([("p", day, 1), ("p", day, 2), ("p", day, 2), ("q", day, 1), (None, day, 1), ("r", day, 4), ("r", day, 5)], "prefix string, ts timestamp, card int")
    assert rows(tables.cards_per_range(own, "prefix", "ts", "card"), "cards", "n", "range_days") == {(2, 5, 2)}
    rated = own.withColumns({"amount": F.lit(1.0), "fraud": F.col("card") == 1})
    assert [tuple(r) for r in tables.ranges_by_rate(rated, "prefix", F.col("fraud"), "amount", 2, 2).collect()] == [("p", 3, 1, 33.33), ("r", 2, 0, 0.0)]


def test_mixed_types(spark):
    own = spark.createDataFrame([("1", "000", "1.5", " ", "a", 1), (" -2 ", "7", "2e3", None, "b", 2), (None, None, "3", "", None, 3)], "id string, code string, rate string, blank string, `na.me` string, n int")
    mix = schema.type_mix(own)
    assert rows(mix, "column", "n", "n_integer", "n_number", "n_text", "kind") == {("id", 2, 2, 0, 0, "integer"), ("code", 2, 1, 0, 1, "mixed"), ("rate", 3, 1, 2, 0, "number"), ("blank", 0, 0, 0, 0, "empty"), ("na.me", 2, 0, 0, 2, "text")}
    out = schema.settle_types(own)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "string", "double", "string", "string", "int"]
    assert rows(out, "id", "code", "rate") == {(1, "000", 1.5), (-2, "7", 2000.0), (None, None, 3.0)}
    assert schema.type_mix(own.select("n")).count() == 0


def test_column_report_and_header(spark, tmp_path):
    own = spark.createDataFrame([("x", None), (" ", 2)], "Name string, `Card Number` int")
    out = readers.column_diagnostics(own, ["name", "number of card", "zip", "CARD  NUMBER"])
    assert rows(out, "wanted", "status", "column", "similar", "n_filled") == {("name", "found", "Name", None, 1), ("number of card", "missing", None, "Card Number", None), ("zip", "missing", None, None, None), ("CARD  NUMBER", "found", "Card Number", None, 1)}
    (tmp_path / "a.csv").write_text("report\n\nname,zip,k\n1,2,3\n")
    assert readers.find_header(spark, str(tmp_path / "a.csv"), ["Zip", "Name"]) == 2

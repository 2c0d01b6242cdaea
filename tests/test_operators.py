"""Small frames with nulls, ties and edges for the other operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cardsieve.functions import amounts, bands, calendar, labels, parsing, scores, text
from cardsieve.operators import attribution, cases, models, profiles, rules, series, stats, tables
from cardsieve.sources import medallion, readers, schema
from cardsieve.streaming import windows


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column, **row):
    types = {str: "string", float: "double", int: "long", datetime: "timestamp", date: "date", type(None): "string", list: "array<string>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in row.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("31/12/2025", date(2025, 12, 31)), ("2025/1/2", date(2025, 1, 2)), ("20250102", date(2025, 1, 2)), ("20250102.0", date(2025, 1, 2)), ("2025-01-02", date(2025, 1, 2)), ("0", None), ("", None), ("None", None), ("99/99/2025", None), (None, None)])
def test_parse_date(spark, raw, want):
    assert one(spark, parsing.parse_date(F.col("a")), a=raw) == want


def test_parse_localized_timestamp(spark):
    assert one(spark, parsing.parse_localized_timestamp(F.col("a")), a="31 mar. 2026 22:52:29") == datetime(2026, 3, 31, 22, 52, 29)
    assert one(spark, parsing.parse_localized_timestamp(F.col("a")), a="31 foo. 2026 22:52:29") is None


@pytest.mark.parametrize("raw,decimal,want", [("1,234.50", ".", 1234.5), ("1.234,50", ",", 1234.5), (" 7 ", ".", 7.0), ("x", ".", None), (None, ".", None)])
def test_parse_amount(spark, raw, decimal, want):
    assert one(spark, parsing.parse_amount(F.col("a"), decimal), a=raw) == want


def test_timestamp_of(spark):
    assert one(spark, parsing.timestamp_of(F.col("a"), F.col("b")), a="20240102", b="x 1:02:03 y") == datetime(2024, 1, 2, 1, 2, 3)
    assert one(spark, parsing.timestamp_of(F.col("a"), F.col("b")), a="20240102", b=None) == datetime(2024, 1, 2)


def test_parse_subject(spark):
    p = parsing.parse_subject(F.col("a"), {"block": ["block", "bloqueo"]})
    df = spark.createDataFrame([("RE: FW: Block - 12345678 - Ana Lopez-Diaz",), ("bloqueo 12345678",), ("hello",), (None,)], "a string").select(*[c.alias(n) for n, c in p.items()])
    assert [tuple(r)[:4] for r in df.collect()] == [("block", "12345678", "Ana Lopez-Diaz", 1), ("block", "12345678", None, 0), (None, None, None, 0), (None, None, None, 0)]
    assert df.collect()[1].missing == ["name"]


def test_body_parsers(spark):
    body = "Hello\n(A1) - first thing : 12\n(B+C) - other : 3\nAna Perez\nFraud Analyst\n"
    rows = one(spark, parsing.parse_count_lines(F.col("a")), a=body)
    assert [(r.code, r.description, r.n) for r in rows] == [("A1", "first thing", 12), ("B+C", "other", 3)]
    assert one(spark, parsing.signature_name(F.col("a"), "analyst"), a=body) == "Ana Perez"
    assert one(spark, parsing.parse_labelled_body(F.col("a"), {"n": r"other : (\d+)", "z": r"zzz (\d+)"})["z"], a=body) == "-"


@pytest.mark.parametrize("x,closed,want", [(0.0, "right", None), (0.5, "right", "a"), (1.0, "right", "a"), (1.0, "left", "b"), (2.0, "right", "b"), (2.0, "left", None), (None, "left", None)])
def test_banded(spark, x, closed, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(bands.banded(F.col("x"), (0, 1, 2), ("a", "b"), closed)).first()[0] == want


def test_quantile_buckets_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [1] * 8 + [2, 3]] + [(None,)], "x double")
    got = sorted((r.x or 0, r.decile) for r in tables.with_quantiles(df, "x").collect())
    assert got[0] == (0, None) and {b for x, b in got if x == 1} == {1} and got[-1][1] > got[-2][1]


def test_labels_and_text(spark):
    assert one(spark, labels.code_flag(F.col("a"), ("02", "5")), a=" 002 ") == 1
    assert one(spark, labels.code_flag(F.col("a"), ("02",)), a=None) == 0
    assert one(spark, labels.label_map(F.col("a"), {"F": "fraud"}, "?"), a=None) == "?"
    assert one(spark, labels.classify_by_keywords(F.col("a"), [("x", ["foo"]), ("y", ["fo"])]), a="a FOOD") == "x"
    assert one(spark, labels.approval_status(F.col("a")), a="00 ") == "approved"
    assert one(spark, text.normalize_text(F.col("a")), a=' ="abc.0" ') == "ABC"
    assert one(spark, text.normalize_value(F.col("a")), a=" ÁÉ  ñ ") == "ae n"
    assert one(spark, text.row_hash(["a", "b"]), a=None, b="x") == one(spark, text.row_hash(["a", "b"]), a="", b="x")
    line = text.fixed_width([text.Field(F.col("a"), 5, "0", True), text.Field(F.col("b"), 3)])
    assert one(spark, line, a="12", b="abcdef") == "00012abc"


def test_calendar(spark):
    c = calendar.Calendar(holidays=("2024-01-15",), recurring=(("01-15", "kings"),), ranges=(("2024-01-10", "2024-01-20", "sale"),))
    assert one(spark, calendar.event_label(F.col("a"), c), a=date(2024, 1, 15)) == "kings + sale + pay day + holiday"
    assert one(spark, calendar.event_label(F.col("a"), c), a=date(2024, 2, 1)) is None
    assert one(spark, calendar.days_between(F.col("a"), F.col("b")), a=datetime(2024, 1, 1, 12), b=datetime(2024, 1, 1)) == -1


def test_scores_and_amounts(spark):
    df = spark.createDataFrame([(1, None, 60.0)], "a int, b int, v double")
    assert df.select(scores.composite_score(["a", "b"])).first()[0] == 1
    assert df.select(scores.weighted_score({"a": 2.0, "b": 5.0}, F.lit(0.4))).first()[0] == 4.0
    assert df.select(scores.threshold_flags({"v": (50, 70), "a": (1,)}, [("v", "a")])["v_ge_50_a_ge_1"]).first()[0] == 1
    assert df.select(amounts.robust_divide(F.col("v"), F.lit(0))).first()[0] is None
    b = amounts.brand_score(F.lit(999.0), F.lit("4"), F.lit("TC"), {"4": 99, "5": 999})
    assert df.select(b["score_norm"], b["score_class"]).first()[:] == (1.0, "high")
    c = amounts.currency_inference(F.lit(100.0), F.lit(25.0), F.lit(25.001), F.lit("978"))
    assert df.select(c["currency"], c["is_unusual_currency"]).first()[:] == ("usd", 1)


def daily(spark, spec):
    return spark.createDataFrame([(k, date(2024, 1, d), n) for k, d, n in spec], "k string, day date, n long")


def test_densify_has_no_gaps(spark):
    out = series.densify(daily(spark, [("a", 1, 5), ("a", 4, 2), ("b", 3, 1)]), ["k"], ["n"])
    assert sorted(values(out, "k", "n")) == [("a", 0), ("a", 0), ("a", 2), ("a", 5), ("b", 0), ("b", 1)]


def test_robust_z_alerts_on_the_spike_only(spark):
    spec = [("flat", d, 12) for d in range(1, 31)] + [("spike", d, 10 + d % 2) for d in range(1, 30)] + [("spike", 30, 60)] + [("short", d, 9) for d in range(25, 31)]
    out = series.robust_z(daily(spark, spec), ["k"], "n")
    assert values(out.filter("alert = 1"), "k", "day") == [("spike", date(2024, 1, 30))]
    assert out.filter("k = 'short' and z is not null").count() == 0


def test_profiles_keep_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 7.0), (3, None, 1.0)], "id long, k string, v double")
    out = {r.id: r for r in profiles.group_zscore(df, ["k"], "v").collect()}
    assert out[3].z is None and out[1].z == pytest.approx(-1 / 2**0.5)
    p = {r.id: r for r in profiles.predominant(df.withColumn("c", F.lit("x")), "c", ["k"]).collect()}
    assert p[1].predominant == "x" and p[3].predominant is None


def test_double_charge(spark):
    df = spark.createDataFrame([(1, "a", 10.0, datetime(2024, 1, 1)), (2, "a", 10.001, datetime(2024, 1, 3)), (3, "a", 10.0, datetime(2024, 2, 1)), (4, "a", 11.0, datetime(2024, 1, 1))], "id long, k string, v double, ts timestamp")
    assert {r.id: r.is_double for r in profiles.double_charge(df, ["k"], "v", "ts", "id").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


@pytest.mark.parametrize("x,dof,want", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2_tail(x, dof, want):
    assert attribution.chi2_tail(x, dof) == pytest.approx(want, abs=1e-9)


def test_shares_sum_to_one(spark):
    rows = [("m", date(2024, 1, 10), datetime(2024, 1, 10), c) for c in "aaab"] + [("m", date(2024, 1, 10), datetime(2024, 1, d), "a") for d in range(1, 10)]
    detail = spark.createDataFrame([(k, ts, c) for k, _, ts, c in rows], "k string, ts timestamp, c string")
    alerts = spark.createDataFrame([("m", date(2024, 1, 10))], "k string, day date")
    out = attribution.share_of_excess(attribution.with_baseline(alerts, detail, ["k"], "ts"), ["k"], ["c"])
    assert sum(r.share for r in out.collect()) == pytest.approx(1)
    assert attribution.top_text(out, ["k"]).first().top.startswith("a (")


def test_cascade_totals_equal_the_union(spark):
    df = spark.createDataFrame([(i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(90)], "a boolean, b boolean, f boolean")
    out = rules.cascade(df, {"a": F.col("a"), "b": F.col("b")}, F.col("f")).collect()
    assert sum(r.n for r in out) == df.filter("a or b").count() and out[-1].captured_so_far == df.filter("(a or b) and f").count()
    pairs = rules.rule_pairs(df, {"a": F.col("a"), "b": F.col("b")}, F.col("f")).first()
    assert (pairs.impacted, pairs.captured) == (df.filter("a and b").count(), df.filter("a and b and f").count())


def test_metrics_of_a_perfect_score(spark):
    df = spark.createDataFrame([(i / 100, i >= 50, i) for i in range(100)], "p double, f boolean, id long")
    m = stats.binary_metrics(df, "p", F.col("f")).first()
    assert (m.auc, m.ks, m.gini, m.tp, m.fp) == (pytest.approx(1), pytest.approx(1), pytest.approx(1), 50, 0)
    lift = stats.decile_lift(df, "p", "id", F.col("f")).orderBy("decile").collect()
    assert [r.n for r in lift] == [10] * 10 and lift[4].capture == pytest.approx(1)
    assert stats.best_cut(df, "p", F.col("f")).first().score == 0.5
    assert stats.psi(df, df, ["p"]).first().psi == pytest.approx(0)


def test_request_reply(spark):
    rows = [("t", 1, "q", "ana", ["desk"]), ("t", 2, "r", "desk", ["bob"]), ("t", 3, "r", "desk", ["ana", "x"]), ("u", 2, "q", "eva", ["desk"]), ("u", 1, "r", "desk", ["eva"])]
    df = spark.createDataFrame(rows, "thread string, at long, kind string, who string, to array<string>")
    out = {r.thread: r for r in cases.pair_request_reply(df, "thread", "at", F.col("kind") == "q", F.col("kind") == "r", F.col("who"), F.col("to")).collect()}
    assert (out["t"].reply_at, out["t"].status, out["u"].status) == (3, "answered", "pending")


def test_cases(spark):
    html = "<p>x<table><tr><th>Code</th><th>Note</th></tr><tr><td>A&amp;1</td><td></td></tr><tr><td>B</td><td>n <b>m</b></td></tr><tr><td>B</td></tr></table><table><tr><td>z</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table>")], "page_id long, html string")
    rows = cases.html_table_rows(pages, "page_id", "html", "code")
    out = cases.expand_conditions(rows, {"note": "-"}).orderBy("code")
    assert values(out, "code", "note") == [("A&1", "-"), ("B", "n m")]
    stored = spark.createDataFrame([(1, "pending", None)], "k long, status string, by string")
    new = cases.insert_new(stored, spark.createDataFrame([(1, "x", "y"), (2, "pending", "z")], stored.schema), ["k"])
    done = cases.approve_pending(new, spark.createDataFrame([(1, "approved", "me")], stored.schema), ["k"], values=["by"])
    assert sorted(values(done, "k", "status", "by")) == [(1, "approved", "me"), (2, "pending", "z")]
    good, bad = cases.complete_and_pending(done.withColumn("by", F.when(F.col("k") == 1, F.col("by"))), ["by"])
    assert (good.count(), bad.first().missing) == (1, ["by"])


def test_schema_tools(spark):
    a = spark.createDataFrame([("1", 2)], "x string, y int")
    b = spark.createDataFrame([(3, 4.5, "z")], "x int, y double, w string")
    out = schema.align(a, b)
    assert dict(out.dtypes) == {"x": "string", "y": "double", "w": "string"} and out.count() == 2
    n = spark.createDataFrame([(1,)], "x int")
    assert schema.align(n, spark.createDataFrame([("q",)], "x string")).schema["x"].dataType == StringType()
    assert schema.align(n, spark.createDataFrame([("7",)], "x string")).schema["x"].dataType.simpleString() == "int"
    s = schema.resolve_synonyms(spark.createDataFrame([(1, 2)], "`Número` int, `Otra cosa` int"), {"id": ["numero"], "amount": ["monto"]})
    assert s.columns == ["id", "amount"] and s.first().id == 1
    m = schema.standardize(a, StructType([StructField("x", LongType()), StructField("q", DoubleType())]))
    assert m.first()[:] == (1, None)
    assert schema.schema_drift(b.schema, a.schema) == [("w", "added"), ("x", "common"), ("y", "common")]


def test_reading_and_medallion(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id; name ;k\n1;x;\n;;\n2;y;3\n", encoding="utf-8")
    path = str(tmp_path / "a.csv")
    assert readers.sniff_separator(spark, path) == ";"
    df = readers.read_text_table(spark, path, ";")
    assert df.columns == ["id", "name", "k", "source_file"] and df.count() == 2
    assert {r.status for r in readers.column_diagnostics(df, ["Name", "zip"]).collect()} == {"found", "missing"}
    silver, log = str(tmp_path / "silver"), str(tmp_path / "log")
    assert medallion.append_silver(spark, df, silver, "2024-01-01") is None
    medallion.append_silver(spark, df, silver, "2024-01-01")
    drift = medallion.append_silver(spark, df.withColumn("extra", F.lit(1)), silver, "2024-01-02")
    assert ("extra", "added") in values(drift, "column", "status")
    assert spark.read.option("mergeSchema", True).parquet(silver).count() == 4  # the day's rerun replaced the day

    def fails():
        raise RuntimeError("no source")

    out = medallion.run_daily(spark, log, {"a": lambda: 5, "b": fails, "c": lambda: 7})
    assert [e["rows"] for e in out] == [5, 0, 7] and "no source" in out[1]["status"] and spark.read.parquet(log).count() == 3
    declines = spark.createDataFrame([("63", None), ("63", ""), ("63", "NM"), ("00", None), ("63", "ok")], "code string, cond string")
    assert medallion.valid_declines(declines, "code", "cond").count() == 3


def test_numbering_and_samples(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    out = tables.numbered(df, ["x"], 10, 300).orderBy("number").collect()
    assert [r.number for r in out] == list(range(11, 1011)) and [r.x for r in out] == sorted(r.x for r in out) and out[-1].chunk == 4
    assert values(tables.steady_sample(df, "id", 5), "id") == values(tables.steady_sample(df, "id", 5), "id")


def test_isolation_forest_finds_the_outlier(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(500)] + [(999, 90.0, -80.0)], "id long, a double, b double")
    out = models.isolation_forest(df, ["a", "b"], "id", trees=40, contamination=0.002)
    assert out.orderBy(F.desc("anomaly_score")).first().id == 999
    e = models.elliptic_outliers(df, ["a", "b"], 0.002)
    assert e.orderBy(F.desc("distance")).first().id == 999


def test_logistic_separates(spark):
    df = spark.createDataFrame([(i, float(i % 50), None if i % 9 == 0 else 1.0, int(i % 50 > 40)) for i in range(600)], "id long, a double, b double, y int")
    train, test = models.split(df, "id")
    out = models.scores(models.logistic(train, ["a", "b"], "y"), test, ["a", "b"])
    assert stats.binary_metrics(out, "p_fraud", F.col("y") == 1).first().auc > 0.95


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m), 1.0) for m in range(30)], "k string, ts timestamp, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.velocity_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "ts", "10 minutes", "5 minutes", "1 hour", "v")
    q = stream.writeStream.format("memory").queryName("v").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select max(n) from v").first()[0] == 10
    seen = []
    for _ in range(2):
        windows.process_new_files(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "cp"), lambda df, k: seen.append(df.count()))
    assert sum(seen) == 30

"""Versions that swap in one step, loads with counts, and rules however many."""

import itertools
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cardsieve.operators import cases, models, rules
from cardsieve.sources import medallion, versions


@pytest.fixture
def tables(spark, tmp_path):
    return versions.Versions(spark, f"file://{tmp_path}/tables")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def gold(df):
    return df.groupBy("kind").agg(F.sum("x").alias("x"))


def test_counts_of_loads(spark, tables):
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "a", 2), (None, "b", 3), (None, "b", 3), (3, "b", -1)], "id int, kind string, x int")
    assert versions.load(tables, first, ["id"], gold, F.col("x") > 0) == {"read": 6, "new": 2, "updated": 0, "skipped": 1, "errors": 3, "version": 1}
    assert rows(tables.read("gold")) == [("a", 3)]
    assert versions.load(tables, first, ["id"], gold, F.col("x") > 0) == {"read": 6, "new": 0, "updated": 0, "skipped": 3, "errors": 3, "version": 1}
    second = spark.createDataFrame([(1, "a", 5, 1), (1, "c", 9, 2), (2, "a", 2, 1), (4, "d", 7, 1)], "id int, kind string, x int, at int")
    assert versions.load(tables, second.drop("at"), ["id"], gold, order=None)["version"] == 2
    counts = versions.load(tables, second, ["id"], gold, order="at")
    assert (counts["updated"], counts["skipped"], counts["version"]) == (3, 1, 3)  # the new column is part of a row's state
    assert rows(tables.read("gold")) == [("a", 2), ("c", 9), ("d", 7)]
    assert rows(tables.read("gold", 1)) == [("a", 3)] and tables.numbers() == [1, 2, 3]
    assert versions.load(tables, first.filter("false"), ["id"], gold) == {"read": 0, "new": 0, "updated": 0, "skipped": 0, "errors": 0, "version": 3}


def test_a_load_killed_between_its_writes_changes_nothing(spark, tables, monkeypatch):
    versions.load(tables, spark.createDataFrame([(1, "a", 1)], "id int, kind string, x int"), ["id"], gold)
    before = rows(tables.read("silver")), rows(tables.read("gold"))
    more = spark.createDataFrame([(1, "a", 8), (2, "b", 2)], "id int, kind string, x int")

    def killed(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # silver's part is written, gold isn't
        versions.load(tables, more, ["id"], killed)
    assert (rows(tables.read("silver")), rows(tables.read("gold"))) == before and tables.numbers() == [1]
    with monkeypatch.context() as m:  # both parts are written, the manifest isn't renamed
        m.setattr(versions.Versions, "commit", lambda *a: killed(None))
        with pytest.raises(KeyboardInterrupt):
            versions.load(tables, more, ["id"], gold)
    assert (rows(tables.read("silver")), rows(tables.read("gold"))) == before
    assert len(tables.vacuum()) == 3
    assert versions.load(tables, more, ["id"], gold)["version"] == 2 and rows(tables.read("gold")) == [("a", 8), ("b", 2)]


def test_two_writers_and_a_log(spark, tables, tmp_path):
    df = spark.createDataFrame([(1, "a", 1)], "id int, kind string, x int")
    tables.commit({"silver": [tables.write_part(df, "silver")]}, 0)
    with pytest.raises(RuntimeError):
        tables.commit({"silver": []}, 0)
    line = versions.logged_load(tables, f"file://{tmp_path}/log", "bad", lambda: int("x"))
    assert line["status"].startswith("error: ValueError") and line["version"] == 1
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 1


def test_parts_of_different_types(spark, tables):
    parts = [tables.write_part(spark.createDataFrame(r, s), "t") for r, s in (([(1, 2)], "id int, x int"), ([(2, 2.5)], "id int, x double"), ([(3, "q", "n")], "id int, x string, y string"))]
    assert tables.parts(parts[:2]).dtypes == [("id", "int"), ("x", "double")] and rows(tables.parts(parts[:2])) == [(1, 2.0), (2, 2.5)]
    assert tables.parts(parts).dtypes == [("id", "int"), ("x", "string"), ("y", "string")]


def test_vacuum_keeps_what_versions_name(spark, tables):
    for k in range(4):
        versions.load(tables, spark.createDataFrame([(1, "a", k)], "id int, kind string, x int"), ["id"], gold)
    gone = tables.vacuum(2)
    assert len(gone) == 2 and all(g.startswith("gold-") for g in gone) and tables.numbers() == [3, 4]
    assert rows(tables.read("gold")) == [("a", 3)] and rows(tables.read("gold", 3)) == [("a", 2)]


@pytest.mark.parametrize("bins, mccs, want", [([], [], [1, 2, 3]), (["411111"], [], [2, 3]), ([], ["5411"], [1, 3]), (["411111"], ["5411"], [3])])
def test_each_exclusion_list_applies_by_itself(spark, bins, mccs, want):
    df = spark.createDataFrame([(1, "411111", "6011", "R1"), (2, "422222", "5411", "R1"), (3, "433333", "6011", "R2"), (4, "433333", "6011", " ")], "id int, bin6 string, mcc string, rule_code string")
    assert [r.id for r in medallion.gold_debit(df, ["id"], bins, mccs).orderBy("id").collect()] == want


def test_a_fill_value_is_filled_in(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (None, 4.0)], "a double, b double")
    out = Pipeline(stages=models.impute_scale(["a", "b"], fill=-1.0, scale=False)).fit(df).transform(df)
    assert [r.features.toArray().tolist() for r in out.collect()] == [[1.0, -1.0], [-1.0, 2.0], [-1.0, 4.0]]


def test_which_of_several_new_cases_stays(spark):
    stored = spark.createDataFrame([("a", "stored", 1)], "k string, v string, at int")
    new = spark.createDataFrame([("a", "x", 1), ("b", "old", 1), ("b", "late", 3), ("b", "mid", 2)], "k string, v string, at int").repartition(3)
    assert rows(cases.insert_new(stored, new, ["k"], ["at"])) == [("a", "stored", 1), ("b", "late", 3)]
    pending = spark.createDataFrame([("b", "pending", None)], "k string, status string, by string")
    approvals = spark.createDataFrame([("b", "no", "x", 1), ("b", "yes", "y", 2)], "k string, status string, by string, at int")
    assert rows(cases.approve_pending(pending, approvals, ["k"], values=["by"], order=["at"])) == [("b", "yes", "y")]


def test_pairs_of_forty_rules(spark):
    rng = random.Random(8)
    data = [([rng.random() < 0.3 for _ in range(40)], rng.random() < 0.2, float(rng.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame([(*[int(x) for x in on], f, x) for on, f, x in data], ", ".join([*[f"c{k} int" for k in range(40)], "f boolean", "x double"])).repartition(5)
    named = {f"r{k:02d}": F.col(f"c{k}") == 1 for k in range(40)}
    got = {(r["first"], r["second"]): (r.impacted, r.captured, r.other) for r in rules.rule_pairs(df, named, F.col("f"), least=0).collect()}
    want = {}
    for i, j in itertools.combinations(range(40), 2):
        met = [(f, x) for on, f, x in data if on[i] and on[j]]
        if met:
            want[f"r{i:02d}", f"r{j:02d}"] = (len(met), sum(f for f, _ in met), sum(not f for f, _ in met))
    assert got == want
    combined = {r.rule: (r.impacted, r.captured, r.fraud_amount) for r in rules.combinations(df, named, F.col("f"), "x", {"big": F.col("x") > 4}, score="x", cuts=(5, 8), least=0).collect()}
    met = [(f, x) for on, f, x in data if on[3] and x > 4]
    assert combined["big AND r03"] == (len(met), sum(f for f, _ in met), pytest.approx(sum(x for f, x in met if f)))
    assert combined["x >= 8"][0] == sum(x >= 8 for _, _, x in data) and len(combined) == len(want) + 40 + 2

"""Properties of models and detectors; local outliers against brute force."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardsieve.operators import models
from cardsieve.plans import queries_models


def rows(spark, sf, name):
    return entry.queries()[name](spark, sf).toPandas()


def auc(p, y):
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_forest_learns_its_label(spark, sf):
    out = rows(spark, sf, "forest_scores").set_index("event_id")
    own = spark.read.parquet(f"{sf}/events.parquet").select("event_id", ((F.col("value") > 60) & (F.get_json_object("props", "$.k").cast("long") > 40)).cast("int").alias("y")).toPandas().set_index("event_id")
    assert len(out) == len(own) and out.p_fraud.between(0, 1).all() and auc(out.p_fraud.to_numpy(), own.y.reindex(out.index).to_numpy()) > 0.95
    assert set(out.risk_class) <= {"low", "medium", "high", "critical"}


@pytest.mark.parametrize("name", ["logistic_scores", "boosted_scores", "forest_scores"])
def test_scores_in_a_session_whose_jobs_have_a_tag(spark, sf, name):
    tagged = spark.newSession()
    tagged.addTag("round")
    try:
        out = rows(tagged, sf, name)
    finally:
        tagged.removeTag("round")
    assert len(out) and out.p_fraud.between(0, 1).all()


def test_features_are_written_once(spark, sf):
    files = queries_models._features(spark, sf).inputFiles()
    assert files and not any("events.parquet" in f for f in files)


def test_boosted_trees_of_distinct_rows_score_as_those_of_all_rows(spark, monkeypatch):
    # 18,000 rows: MLlib draws candidates of splits from 10,000, which is no matter for so few values
    df = spark.range(18000).select("id", F.when(F.col("id") % 29 > 0, F.col("id") % 20).alias("a"), (F.hash("id") % 6).alias("b"))
    df = df.withColumn("y", ((F.coalesce("a", F.lit(10)) > 9) & (F.hash("id", F.lit(3)) % 5 > -2)).cast("int"))
    train, test = models.split(df, "id")
    fitted, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: fitted.append(rows) or fit(self.setMaxIter(4), rows))
    model, _ = models.boosted_if_better(train, test, ["a", "b"], "y", enough=1.01, gain=-1.0)
    own = models.balanced(models._doubles(train, ["a", "b"]), "y")
    whole = Pipeline(stages=[*models.impute_scale(["a", "b"], scale=False), GBTClassifier(labelCol="y", weightCol="weight", maxIter=4, seed=42)]).fit(own)
    assert fitted[0].count() < 500 and fitted[0].agg(F.sum("weight")).first()[0] == pytest.approx(own.count())
    got, want = (models.scores(m, test, ["a", "b"]).orderBy("id").toPandas().p_fraud for m in (model, whole))
    assert got.to_numpy() == pytest.approx(want.to_numpy(), abs=1e-9) and got.nunique() > 2


def test_anomalies_are_the_few_with_the_highest_scores(spark, sf):
    out = rows(spark, sf, "isolation_scores")
    assert 0 < out.is_anomaly.mean() <= 0.011 and out.anomaly_score[out.is_anomaly == 1].min() >= out.anomaly_score[out.is_anomaly == 0].max()


def test_clusters_hold_all_rows(spark, sf):
    out = rows(spark, sf, "behaviour_clusters")
    assert out[[c for c in out.columns if c in ("n", "rows")][0]].sum() == spark.read.parquet(f"{sf}/events.parquet").count() and len(out) <= 4


def test_components_are_uncorrelated(spark, sf):
    out = rows(spark, sf, "principal_components")
    assert out.x.var() >= out.y.var() and abs(np.corrcoef(out.x, out.y)[0, 1]) < 1e-6


@pytest.mark.parametrize("block", [2048, 20])
def test_local_outliers_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(0, 0.1, (30, 3)) + 6, [[20.0, 0, 0]]])
    k = 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, near, 1).max(axis=1)
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(axis=1) + 1e-10)
    want = lrd[near].mean(axis=1) / lrd
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = models.local_outliers(df, "v", "id", k=k, block=block).toPandas().sort_values("id").lof.to_numpy()
    assert got == pytest.approx(want, rel=1e-9) and got.argmax() == 90


def test_tree_bands_part_the_values(spark):
    df = spark.range(2000).select((F.col("id") % 500 / 5.0).alias("v"), (F.col("id") % 500 >= 450).cast("int").alias("y"))
    out = models.tree_bands(df, "v", "y").toPandas().sort_values("low")
    assert out.n.sum() == 2000 and out.frauds.sum() == 200 and (out.high.to_numpy()[:-1] < out.low.to_numpy()[1:]).all()
    assert (out.action == np.where(out.rate >= 0.05, "block", np.where(out.rate >= 0.02, "review", "pass"))).all() and {"block", "pass"} <= set(out.action)
    assert out.fraud_share.sum() == pytest.approx(1)
    assert models.tree_bands(df.filter("y = 0"), "v", "y").count() == 1


def test_rows_without_a_vector_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0])], "id long, v array<double>")
    got = {r.id: r.lof for r in models.local_outliers(df, "v", "id", k=2).collect()}
    assert len(got) == 6 and all(got[i] == 10.0 for i in (4, 5, 6)) and all(got[i] < 10.0 for i in (1, 2))
    assert models.local_outliers(df.filter("false"), "v", "id").count() == 0

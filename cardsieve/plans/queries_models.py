"""Queries of models and detectors; where SQL can't express them, tests hold their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, models, stats, velocity
from ..sources.scratch import written
from .registry import T, events, purchases, query

_FEATURES = ["value", "k", "n_1h", "n_24h", "hour"]


def _features(spark, sf_dir, names=_FEATURES):
    """event_id, features and label, written once: models read their rows many times."""
    own = velocity.velocity(events(spark, sf_dir), ["user_id"], "ts", "event_id", None, {"1h": 3600, "24h": 86400})
    own = own.withColumns({"hour": F.hour("ts"), "label": (F.coalesce(F.col("value") > 60, F.lit(False)) & (F.col("k") > 40)).cast("int")})
    return written(own.select("event_id", *names, "label"), "features")


@query()
def logistic_scores(spark, sf_dir):
    df = _features(spark, sf_dir)
    train, test = models.split(df, "event_id")
    return models.scores(models.logistic(train, _FEATURES, "label"), test, _FEATURES).select("event_id", "label", "p_fraud", "risk_class")


@query()
def boosted_scores(spark, sf_dir):
    df = _features(spark, sf_dir, ["k", "hour"])
    train, test = models.split(df, "event_id")
    model, _ = models.boosted_if_better(train, test, ["k", "hour"], "label")
    return models.scores(model, test, ["k", "hour"]).select("event_id", "p_fraud", "risk_class")


@query()
def forest_scores(spark, sf_dir):
    df = _features(spark, sf_dir)
    model, _ = models.forest_importance(df, _FEATURES, "label", "event_id", trees=20, depth=5)
    return models.scores(model, df, _FEATURES).select("event_id", "p_fraud", "risk_class")


@query()
def isolation_scores(spark, sf_dir):
    return models.isolation_forest(_features(spark, sf_dir), _FEATURES, "event_id", trees=50).select("event_id", "anomaly_score", "is_anomaly")


@query()
def local_outliers(spark, sf_dir):
    return models.local_outliers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")


@query()
def behaviour_clusters(spark, sf_dir):
    df = models.clusters(_features(spark, sf_dir), _FEATURES, 4).withColumn("large", (F.col("value") > 60).cast("int"))
    return stats.cluster_profile(df, "cluster", _FEATURES, ["large"], F.col("label"))


@query()
def principal_components(spark, sf_dir):
    return models.project_2d(_features(spark, sf_dir), _FEATURES)[0].select("event_id", "x", "y")


@query()
def elliptic_outliers(spark, sf_dir):
    return models.elliptic_outliers(_features(spark, sf_dir), _FEATURES).select("event_id", "distance", "is_elliptic_outlier")


@query(T + """, p AS (SELECT client AS id, CAST(count(*) AS DOUBLE) AS x, sum(qty) / count(*) AS y FROM t GROUP BY client),
    near AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS far FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.36),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 8),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    cc AS (WITH RECURSIVE r AS (SELECT id AS node, id AS root FROM core UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.node) SELECT node, min(root) AS cluster FROM r GROUP BY node),
    border AS (SELECT a AS id, arg_min(b, (far, b)) AS q FROM near WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) GROUP BY a)
    SELECT p.id AS client, coalesce(cc.cluster, bc.cluster) AS cluster, CAST(cc.node IS NOT NULL AS INT) AS is_core
    FROM p LEFT JOIN cc ON cc.node = p.id LEFT JOIN border ON border.id = p.id LEFT JOIN cc bc ON bc.node = border.q""")
def density_clusters(spark, sf_dir):
    own = purchases(spark, sf_dir).groupBy("client").agg(F.count(F.lit(1)).cast("double").alias("x"), (F.sum("qty") / F.count(F.lit(1))).alias("y"))
    return density.dbscan(own, "client", ["x", "y"], 0.6, 8)

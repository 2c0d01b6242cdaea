"""Scoring and anomaly models: MLlib pipelines, and detectors that MLlib lacks as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, PCA, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_folder
from .neighbours import nearest_rows
from .quantiles import percentiles


def split(df: DataFrame, row_id: str, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id: the same rows each time, in like shares of every label."""
    u = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return df.filter(u < train), df.filter(u >= train)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Column weight: classes weigh the same in all."""
    counts = F.broadcast(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))  # a row for each class
    total = F.broadcast(counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k")))
    return df.join(counts, label).crossJoin(total).withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def impute_scale(features: Sequence[str], fill: float | None = None, scale: bool = True) -> list:
    """Stages that fill nulls by the median, or by the value ``fill``, and scale to ``features``."""
    names = [f"{c}__filled" for c in features]
    if fill is None:
        stages = [Imputer(strategy="median", inputCols=list(features), outputCols=names)]
    else:
        filled = ", ".join(f"coalesce(nanvl(cast(`{c}` as double), {float(fill)}), {float(fill)}) AS `{n}`" for c, n in zip(features, names))
        stages = [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")]
    stages.append(VectorAssembler(inputCols=names, outputCol="raw_features" if scale else "features", handleInvalid="keep"))
    return stages + ([StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)] if scale else [])


def _doubles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model written and read back, without the summary of its training. Summaries of two classes hold the session,
    which can't be sent to tasks once its jobs have a tag (``addTag``), so neither could the model."""
    path = new_folder(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


def logistic(train: DataFrame, features: Sequence[str], label: str, reg: float = 0.01) -> PipelineModel:
    """Logistic regression on scaled features with balanced classes."""
    stages = [*impute_scale(features), LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, maxIter=50)]
    return without_summary(Pipeline(stages=stages).fit(balanced(_doubles(train, features), label)), train.sparkSession)


def coefficients(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float, float]]:
    """Name, coefficient and odds ratio of each feature."""
    return [(n, float(c), float(np.exp(c))) for n, c in zip(features, model.stages[-1].coefficients)]


def boosted_if_better(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, enough: float = 0.75, gain: float = 0.03) -> tuple[PipelineModel, float]:
    """The logistic model, or boosted trees if its AUC is below ``enough`` and theirs is at least ``gain`` better.

    Trees are fitted to the distinct rows, weighted by their number, so their work follows the distinct values of features.
    """
    auc = BinaryClassificationEvaluator(labelCol=label).evaluate
    first = logistic(train, features, label)
    score = auc(first.transform(_doubles(test, features)))
    if score >= enough:
        return first, score
    own = balanced(_doubles(train, features), label)
    fill, assemble = impute_scale(features, scale=False)
    filled = fill.fit(own)
    # equal rows count as one row of their weight
    alike = filled.transform(own).groupBy(label, "weight", *fill.getOutputCols()).count().withColumn("weight", F.col("weight") * F.col("count"))
    boosted = GBTClassifier(labelCol=label, weightCol="weight", maxIter=30, seed=42).fit(assemble.transform(alike))
    trees = PipelineModel([filled, assemble, boosted])
    other = auc(trees.transform(_doubles(test, features)))
    return (trees, other) if other >= score + gain else (first, score)


def forest_importance(df: DataFrame, features: Sequence[str], label: str, row_id: str, per_fraud: int = 5, trees: int = 200, depth: int = 8) -> tuple[PipelineModel, list[tuple[str, float]]]:
    """Random forest on all frauds and ``per_fraud`` times as many others; importances from the largest."""
    counts = df.agg(F.sum(F.col(label).cast("int")).alias("f"), F.count(F.lit(1)).alias("n")).first()
    share = min(1.0, per_fraud * (counts.f or 0) / max(counts.n - (counts.f or 0), 1))
    own = df.filter((F.col(label) == 1) | (F.pmod(F.xxhash64(F.col(row_id), F.lit(7)), F.lit(1_000_000)) < share * 1e6))
    model = Pipeline(stages=[*impute_scale(features, scale=False), RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=42)]).fit(_doubles(own, features))
    model = without_summary(model, df.sparkSession)
    return model, sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def scores(model: PipelineModel, df: DataFrame, features: Sequence[str], edges: Sequence[float] = (0.30, 0.45, 0.70)) -> DataFrame:
    """Columns p_fraud and risk_class (low, medium, high, critical by the edges)."""
    p = vector_to_array("probability")[1]
    out = model.transform(_doubles(df, features)).withColumn("p_fraud", p)
    kind = F.when(F.col("p_fraud") < edges[0], "low").when(F.col("p_fraud") < edges[1], "medium").when(F.col("p_fraud") < edges[2], "high").otherwise("critical")
    return out.select(*df.columns, "p_fraud", kind.alias("risk_class"))


def tree_bands(df: DataFrame, value: str, label: str, depth: int = 4, least: int = 10, share: float = 0.005, block: float = 0.05, review: float = 0.02) -> DataFrame:
    """Bands of one variable, the leaves of a decision tree: low, high (its values' ends), n, frauds, rate, fraud_share, action.

    A leaf holds ``least`` rows and ``share`` of all at least. The action is to block or review from these rates on, else to pass.
    Rows without value or label are left out; with labels of one class there is one band.
    """
    own = df.select(F.col(value).cast("double").alias("__v"), F.col(label).cast("double").alias("__y")).dropna()
    tree = DecisionTreeClassifier(labelCol="__y", leafCol="__leaf", maxDepth=depth, minInstancesPerNode=max(least, int(own.count() * share)), seed=42)
    model = Pipeline(stages=[VectorAssembler(inputCols=["__v"], outputCol="features"), tree]).fit(own)
    bands = model.transform(own).groupBy("__leaf").agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.col("__y").cast("bigint")).alias("frauds"))
    total = F.sum("frauds").over(Window.partitionBy())  # a row for each leaf
    rate = F.col("frauds") / F.col("n")
    action = F.when(rate >= block, "block").when(rate >= review, "review").otherwise("pass")
    return bands.select("low", "high", "n", "frauds", rate.alias("rate"), (F.col("frauds") / F.nullif(total, F.lit(0))).alias("fraud_share"), action.alias("action"))


# isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """A tree as rows (feature, cut, left, right, size); a leaf has feature -1."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, len(rows)])
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(rows.shape[1])
        open_ = np.flatnonzero(spread > 0)
        if depth < limit and len(open_):
            f = int(rng.choice(open_))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < cut
            nodes[at][:2] = [f, cut]
            nodes[at][2] = add(rows[left], depth + 1)
            nodes[at][3] = add(rows[~left], depth + 1)
        return at

    add(x, 0)
    return np.array(nodes)


def _mean_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _paths(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    at, depth = np.zeros(len(x), int), np.zeros(len(x))
    live = np.flatnonzero(tree[at, 0] >= 0)
    while len(live):
        node = tree[at[live]]
        left = x[live, node[:, 0].astype(int)] < node[:, 1]
        at[live] = np.where(left, node[:, 2], node[:, 3]).astype(int)
        depth[live] += 1
        live = live[tree[at[live], 0] >= 0]
    return depth + _mean_path(tree[at, 4])


def isolation_forest(df: DataFrame, features: Sequence[str], row_id: str, trees: int = 200, sample: int = 256, contamination: float = 0.01, seed: int = 42) -> DataFrame:
    """Columns anomaly_score (0 to 1) and is_anomaly (the top ``contamination`` by score, exact percentile). Nulls count as 0.

    A tree grows from about ``sample`` rows drawn by a seeded hash, each in a task of its own; the forest (trees x sample nodes
    at most) goes to the scoring tasks.
    """
    spark = df.sparkSession
    own = df.select(F.col(row_id).alias("__id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    n = max(own.count(), 1)
    # each row draws the trees it joins: on average trees * sample / n of them
    chance = min(1.0, 1.3 * sample / n)
    draws = own.withColumn("__tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col("__id"), t, F.lit(seed)), F.lit(1_000_000)) < chance * 1e6)))
    names, depth = list(features), int(np.ceil(np.log2(max(sample, 2))))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(key[0]))
        x = rows.sort_values("__id")[names].to_numpy(float)
        x = x[rng.permutation(len(x))[:sample]]
        return pd.DataFrame({"tree": [int(key[0])], "n": [len(x)], "nodes": [_grow(x, rng, depth).astype("<f8").tobytes()]})

    grown = sorted(draws.groupBy("__tree").applyInPandas(grow, "tree long, n long, nodes binary").collect())  # trees x sample nodes at most
    sent = spark.sparkContext.broadcast([(r.n, np.frombuffer(r.nodes).reshape(-1, 5)) for r in grown])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        forest = sent.value
        usual = float(np.mean(_mean_path(np.array([n for n, _ in forest])))) if forest else 1.0
        for rows in batches:
            x = rows.to_numpy(float)
            mean = np.mean([_paths(x, t) for _, t in forest], axis=0) if forest else np.zeros(len(x))
            yield pd.Series(2.0 ** (-mean / max(usual, 1e-9)))

    scored = df.withColumn("anomaly_score", score(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])))
    cut = F.broadcast(percentiles(scored, "anomaly_score", [1 - contamination], "__p").select(F.col("__p")[0].alias("__cut")))  # one row
    return scored.crossJoin(cut).withColumn("is_anomaly", (F.col("anomaly_score") > F.col("__cut")).cast("int")).drop("__cut")


def local_outliers(df: DataFrame, vector: str, row_id: str, k: int = 20, contamination: float = 0.08, block: int = 2048) -> DataFrame:
    """Local outlier factor from the k nearest rows: row_id, lof, is_outlier. Rows without neighbours are outliers of score 10."""
    near = nearest_rows(df, vector, row_id, k, block)
    reach = near.groupBy("a").agg(F.max("d").alias("kd"))
    pairs = near.join(reach.select(F.col("a").alias("b"), F.col("kd").alias("kb")), "b").withColumn("r", F.greatest("d", "kb"))
    density = pairs.groupBy("a").agg((1 / (F.avg("r") + 1e-10)).alias("lrd"))
    lof = near.join(density.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").join(density, "a").groupBy("a").agg((F.avg("lb") / F.first("lrd")).alias("lof"))
    out = df.select(F.col(row_id).alias("a")).join(lof, "a", "left").select(F.col("a").alias(row_id), F.coalesce("lof", F.lit(10.0)).alias("lof"))
    cut = F.broadcast(percentiles(out, "lof", [1 - contamination], "__p").select(F.col("__p")[0].alias("__cut")))  # one row
    return out.crossJoin(cut).withColumn("is_outlier", (F.col("lof") > F.col("__cut")).cast("int")).drop("__cut")


def clusters(df: DataFrame, features: Sequence[str], k: int | None = None, bisecting: bool = False) -> DataFrame:
    """Column cluster by k-means on filled and scaled features; k = min(8, rows / 100) by default."""
    k = k or max(2, min(8, df.count() // 100))
    means = (BisectingKMeans if bisecting else KMeans)(k=k, seed=42, featuresCol="features", predictionCol="cluster")
    model = Pipeline(stages=[*impute_scale(features), means]).fit(_doubles(df, features))
    return model.transform(_doubles(df, features)).select(*df.columns, "cluster")


def project_2d(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Columns x and y (the first two principal components of scaled features) and their explained variance."""
    model = Pipeline(stages=[*impute_scale(features), PCA(k=2, inputCol="features", outputCol="__pca")]).fit(_doubles(df, features))
    a = vector_to_array("__pca")
    return model.transform(_doubles(df, features)).select(*df.columns, a[0].alias("x"), a[1].alias("y")), [float(v) for v in model.stages[-1].explainedVariance]


def elliptic_outliers(df: DataFrame, features: Sequence[str], contamination: float = 0.01, support: float = 0.9) -> DataFrame:
    """Columns distance (Mahalanobis) and is_elliptic_outlier; mean and covariance from the ``support`` share nearest a first fit."""
    own = df.withColumn("__x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))

    def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        d = range(len(features))
        sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("__x")[i]).alias(f"s{i}") for i in d], *[F.sum(F.col("__x")[i] * F.col("__x")[j]).alias(f"p{i}_{j}") for i in d for j in d if i <= j]).first()
        n = max(sums.n, 2)
        mean = np.array([sums[f"s{i}"] or 0.0 for i in d]) / n
        second = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in d] for i in d]) / n
        return mean, np.linalg.pinv(second - np.outer(mean, mean) + 1e-9 * np.eye(len(mean)))

    def distance(mean: np.ndarray, inverse: np.ndarray) -> Column:
        c = [F.col("__x")[i] - float(m) for i, m in enumerate(mean)]
        total = F.lit(0.0)
        for i, row in enumerate(inverse):
            for j, v in enumerate(row):
                total = total + c[i] * c[j] * float(v)
        return F.sqrt(F.greatest(total, F.lit(0.0)))

    first = own.withColumn("__d", distance(*fit(own)))
    cut = percentiles(first, "__d", [support]).first()[0][0]
    out = own.withColumn("distance", distance(*fit(first.filter(F.col("__d") <= cut))))
    limit = F.broadcast(percentiles(out, "distance", [1 - contamination], "__p").select(F.col("__p")[0].alias("__cut")))
    return out.crossJoin(limit).withColumn("is_elliptic_outlier", (F.col("distance") > F.col("__cut")).cast("int")).drop("__cut", "__x")


def moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and variance vectors of the features."""
    v = VectorAssembler(inputCols=list(features), outputCol="v", handleInvalid="skip").transform(_doubles(df, features))
    return v.select(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))

"""Statistics of variables, scores and reconciled sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import group_percentiles, percentiles, placed, value_counts
from .ranges import numbered, with_range


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def iqr_outliers(df: DataFrame, value: str, times: float = 1.5, order: str | None = None) -> DataFrame:
    """Rows whose absolute value is beyond Q3 + times * IQR; with ``order``, column is_last marks the latest row (the alert)."""
    x = F.abs(F.col(value))
    q = percentiles(df, x, (0.25, 0.75), "__q")
    q = F.broadcast(q.crossJoin(df.agg(F.max(order).alias("__last"))) if order else q)  # one row
    out = df.crossJoin(q).withColumn("limit", F.col("__q")[1] + times * (F.col("__q")[1] - F.col("__q")[0])).filter(x > F.col("limit"))
    return (out.withColumn("is_last", (F.col(order) == F.col("__last")).cast("int")).drop("__last") if order else out).drop("__q")


def mann_whitney(df: DataFrame, variables: Sequence[str], group: Column) -> DataFrame:
    """Two-sided rank test of each variable between the rows where ``group`` holds and the others: medians, U, z, p, stars.

    Average ranks come from counts of each distinct value, summed in order; normal approximation with correction for ties.
    """
    long = df.select(F.coalesce(group.cast("int"), F.lit(0)).alias("__g"), *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(["__g"], list(variables), "variable", "x").filter("x is not null")
    value = long.groupBy("variable", "x").agg(F.sum("__g").alias("a"), F.count(F.lit(1)).alias("t"))
    ranked = placed(value, ["variable"], "x", "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy("variable").agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (u - n1 * n2 / 2) / F.nullif(sigma, F.lit(0.0))
    sides = value.select("variable", "x", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("n")), F.struct(F.lit(0).alias("side"), (F.col("t") - F.col("a")).alias("n")))))
    medians = group_percentiles(sides, ["variable", "side"], [0.5], "m").groupBy("variable").agg(*[F.max(F.when(F.col("side") == k, F.col("m")[0])).alias(name) for k, name in ((1, "median_group"), (0, "median_other"))])
    out = sums.select("variable", u.alias("u"), z.alias("z")).withColumn("p", normal_two_sided(F.col("z")))
    p = F.col("p")
    return out.withColumn("stars", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")).join(medians, "variable", "left")


def normal_two_sided(z: Column) -> Column:
    """2 * P(Z > |z|), error below 1.5e-7 (rational approximation of the error function)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def correlations(df: DataFrame, variables: Sequence[str], target: Column, most_null: float = 0.7) -> DataFrame:
    """Pearson correlation of each variable with a target; variables with too many nulls are left out."""
    y = target.cast("double")
    columns = [F.corr(F.col(v).cast("double"), y).alias(f"r{k}") for k, v in enumerate(variables)] + [F.avg(F.col(v).isNull().cast("double")).alias(f"m{k}") for k, v in enumerate(variables)]
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"r{k}").alias("r"), F.col(f"m{k}").alias("null_share")) for k, v in enumerate(variables)])
    return df.agg(*columns).select(F.explode(rows).alias("x")).select("x.*").filter(F.col("null_share") <= most_null)


def correlation_matrix(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of variables (a < b)."""
    pairs = [(a, b) for k, a in enumerate(variables) for b in variables[k + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def psi(train: DataFrame, test: DataFrame, variables: Sequence[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability of each variable: bins by the training quantiles, sum of (q - p) ln(q / p), class."""
    long = lambda df: df.select(*[F.col(v).cast("double").alias(v) for v in variables]).unpivot([], list(variables), "variable", "x").filter("x is not null")
    edges = F.broadcast(group_percentiles(value_counts(long(train), ["variable"], "x"), ["variable"], [k / bins for k in range(1, bins)], "edges").withColumn("edges", F.array_distinct("edges")))  # a row for each variable
    both = long(train).withColumn("side", F.lit("p")).unionByName(long(test).withColumn("side", F.lit("q")))
    binned = both.join(edges, "variable").select("variable", "side", F.size("edges").alias("last"), F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bin"))
    counts = binned.groupBy("variable", "bin").agg(F.count(F.when(F.col("side") == "p", 1)).alias("p"), F.count(F.when(F.col("side") == "q", 1)).alias("q"))
    w = Window.partitionBy("variable")
    p, q = (F.greatest(_share(F.col(c), F.sum(c).over(w)), F.lit(floor)) for c in ("p", "q"))
    out = counts.withColumn("part", (q - p) * F.log(q / p)).groupBy("variable").agg(F.sum("part").alias("psi"))
    return out.withColumn("class", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "shifting").otherwise("shifted"))


def decile_lift(df: DataFrame, score: str, row_id: str, fraud: Column, q: int = 10) -> DataFrame:
    """Deciles by rank, 1 = highest score: n, frauds, rate, capture so far, lift.

    A row's rank is its running number by score, then id, over fixed ranges: equal scores are dealt by their ids, so one score
    that half of all rows share is no hot group.
    """
    own = df.select(F.col(score).alias("__s"), F.col(row_id).alias("__id"), F.coalesce(fraud.cast("int"), F.lit(0)).alias("__f")).filter("__s is not null")
    total = F.broadcast(own.agg(F.count(F.lit(1)).alias("__n")))
    ranked = numbered(own.withColumn("__down", -F.col("__s")), ["__down", "__id"]).withColumnRenamed("number", "rank").crossJoin(total)
    decile = F.floor((F.col("rank") - 1) * q / F.col("__n")) + 1
    out = ranked.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("frauds"), F.min("__s").alias("min_score"), F.max("__s").alias("max_score"))
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # q rows
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = _share(F.col("frauds"), F.col("n"))
    return out.withColumns({"rate": rate, "capture": _share(F.sum("frauds").over(w), F.sum("frauds").over(every)), "lift": _share(rate, _share(F.sum("frauds").over(every), F.sum("n").over(every)))})


def _running(counts: DataFrame, score: str, *sums: str) -> DataFrame:
    """Rows of distinct scores with above (sum of sums[0] over higher scores) and above_<c> for the others; ranges first, then within."""
    dealt = with_range(counts, [score])
    parts = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    w = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("__range", *[F.coalesce(F.sum(f"__t_{c}").over(w), F.lit(0)).alias(f"__b_{c}") for c in sums])
    within = Window.partitionBy("__range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "__range")
    names = {("above" if k == 0 else f"above_{c}"): F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__b_{c}") for k, c in enumerate(sums)}
    return out.withColumns(names).drop("__range", *[f"__b_{c}" for c in sums])


def roc_points(df: DataFrame, score: str, fraud: Column) -> DataFrame:
    """For each distinct score, as a cut: true and false positive rate and their difference (Youden; its maximum is KS)."""
    own = df.select(F.col(score).alias("score"), F.coalesce(fraud.cast("int"), F.lit(0)).alias("f")).filter("score is not null")
    counts = own.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"))
    run = _running(counts, "score", "n", "f")
    total = F.broadcast(counts.agg(F.sum("n").alias("__n"), F.sum("f").alias("__f")))
    tp = F.col("above_f") + F.col("f")
    fp = F.col("above") + F.col("n") - tp
    out = run.crossJoin(total).select("score", "n", "f", _share(tp, F.col("__f")).alias("tpr"), _share(fp, F.col("__n") - F.col("__f")).alias("fpr"))
    return out.withColumn("youden", F.col("tpr") - F.col("fpr"))


def roc_curve(df: DataFrame, score: str, fraud: Column, points: int = 500) -> DataFrame:
    """The last point of each of ``points`` steps of the false positive rate."""
    return roc_points(df, score, fraud).groupBy(F.floor(F.col("fpr") * points).alias("step")).agg(F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr"), F.min("score").alias("score"))


def best_cut(df: DataFrame, score: str, fraud: Column) -> DataFrame:
    """The cut with the largest Youden index; the higher score of several."""
    return roc_points(df, score, fraud).orderBy(F.desc("youden"), F.desc("score")).limit(1).select("score", "tpr", "fpr", "youden")


def binary_metrics(df: DataFrame, probability: str, fraud: Column, cut: float = 0.5, eps: float = 1e-15) -> DataFrame:
    """AUC, Gini, KS, log-loss, F1 and the confusion matrix at a cut, from one table of distinct scores."""
    own = df.select(F.col(probability).alias("score"), F.coalesce(fraud.cast("int"), F.lit(0)).alias("f")).filter("score is not null")
    points = roc_points(own, "score", F.col("f"))
    n, f = F.col("n"), F.col("f")
    totals = F.broadcast(own.agg(F.sum("f").cast("double").alias("p"), F.sum(1 - F.col("f")).cast("double").alias("q")))
    area = points.crossJoin(totals).select("youden", ((F.col("tpr") - f / F.col("p") / 2) * (n - f) / F.col("q")).alias("a"))
    rank = area.agg(F.sum("a").alias("auc"), F.max("youden").alias("ks")).withColumn("gini", 2 * F.col("auc") - 1)
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    hit = F.col("score") >= cut
    count = lambda c: F.count(F.when(c, 1))
    table = own.agg(F.avg(-(F.col("f") * F.log(p) + (1 - F.col("f")) * F.log(1 - p))).alias("log_loss"), count(hit & (F.col("f") == 1)).alias("tp"), count(hit & (F.col("f") == 0)).alias("fp"), count(~hit & (F.col("f") == 1)).alias("fn"), count(~hit & (F.col("f") == 0)).alias("tn"))
    return rank.crossJoin(table).withColumn("f1", _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def reconcile(a: DataFrame, b: DataFrame, day: str, n: str, share: float = 0.005, excess: float = 0.001) -> DataFrame:
    """Both sources' counts on the days that both have, difference, its share of b (null for 0) and alert."""
    x = a.groupBy(day).agg(F.sum(n).alias("a")).join(b.groupBy(day).agg(F.sum(n).alias("b")), day)
    d = _share(F.col("a") - F.col("b"), F.col("b"))
    alert = F.coalesce((F.abs(d) > share) | ((F.col("a") > F.col("b")) & (d > excess)), F.col("a") > 0)
    return x.withColumns({"difference": F.col("a") - F.col("b"), "share": d, "alert": alert.cast("int")})


def expand_codes(df: DataFrame, code: str, separator: str = r"\+") -> DataFrame:
    """A row for each part of a compound code 'A+B'."""
    return df.withColumn(code, F.explode(F.split(code, separator))).withColumn(code, F.trim(code))


def monthly_pairs(pairs: DataFrame, day: str) -> DataFrame:
    """Sums of a and b by month, their difference, and which is larger."""
    out = pairs.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    d = F.col("a") - F.col("b")
    return out.withColumns({"difference": d, "relation": F.when(d > 0, "a larger").when(d < 0, "b larger").otherwise("equal")})


def cluster_profile(df: DataFrame, cluster: str, variables: Sequence[str], flags: Sequence[str], fraud: Column, active: float = 0.5) -> DataFrame:
    """n, frauds, rate, medians, the flags on in at least ``active`` of the rows, and the variables farthest above the overall mean."""
    base = F.broadcast(df.agg(*[F.avg(v).alias(f"__m_{v}") for v in variables]))  # one row
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(fraud.cast("int"), F.lit(0))).alias("frauds"), *[F.percentile(v, F.lit(0.5)).alias(f"median_{v}") for v in variables], *[F.avg(v).alias(f"__a_{v}") for v in variables], *[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"__s_{f}") for f in flags])
    out = out.crossJoin(base)
    ratios = F.array_sort(F.array(*[F.struct((-F.col(f"__a_{v}") / F.nullif(F.col(f"__m_{v}"), F.lit(0.0))).alias("r"), F.lit(v).alias("v")) for v in variables]))
    on = F.array_compact(F.array(*[F.when(F.col(f"__s_{f}") >= active, F.lit(f)) for f in flags])) if flags else F.array().cast("array<string>")
    out = out.withColumns({"rate": _share(F.col("frauds"), F.col("n")), "active_flags": F.array_join(on, ","), "top_variables": F.array_join(F.transform(F.slice(ratios, 1, 3), lambda x: x["v"]), ",")})
    return out.select(cluster, "n", "frauds", "rate", *[f"median_{v}" for v in variables], "active_flags", "top_variables")


def anomaly_overlap(df: DataFrame, first: Column, second: Column, indicator: str) -> DataFrame:
    """Rows that both detectors flag, by indicator, with each one's own count."""
    a, b = (F.coalesce(c.cast("int"), F.lit(0)) for c in (first, second))
    return df.groupBy(indicator).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("first"), F.sum(b).alias("second"), F.sum(a * b).alias("consensus"))


def min_max(df: DataFrame, columns: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Columns brought to 0..1 by their smallest and largest values."""
    ends = F.broadcast(df.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns]))  # one row
    out = df.crossJoin(ends).withColumns({c: (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + eps) for c in columns})
    return out.drop(*[f"__lo_{c}" for c in columns], *[f"__hi_{c}" for c in columns])


def conditional_counts(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """How often each named condition holds in each group."""
    return df.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()])

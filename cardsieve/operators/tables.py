"""Analysis tables: pivots, statistics, deciles, bands and measures. Each is one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bands import quantile_bucket
from ..sources.readers import write_table
from ..sources.scratch import written
from .quantiles import group_percentiles, percentiles, value_counts
from .ranges import numbered


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def pivot_indicator(df: DataFrame, dim: str, indicator: str, values: Sequence[str], fraud: str, top: int | None = None) -> DataFrame:
    """Counts by indicator for each value of a dimension, total, fraud rate; the ``top`` values by total."""
    out = df.groupBy(dim).agg(*[F.count(F.when(F.col(indicator) == v, 1)).alias(f"n_{v}") for v in values], F.count(F.lit(1)).alias("total"))
    out = out.withColumn("fraud_rate", _share(F.col(f"n_{fraud}"), F.col("total")))
    return out.orderBy(F.desc("total"), dim).limit(top) if top else out


def pivot_clients_amounts(df: DataFrame, dim: str, indicator: str, values: Sequence[str], fraud: str, client: str, amount: str) -> DataFrame:
    """Distinct clients and amounts by indicator, severity (fraud amount of all), mean tickets."""
    columns = []
    for v in values:
        own = F.col(indicator) == v
        columns += [F.countDistinct(F.when(own, F.col(client))).alias(f"clients_{v}"), F.coalesce(F.sum(F.when(own, F.col(amount))), F.lit(0.0)).alias(f"amount_{v}"), F.avg(F.when(own, F.col(amount))).alias(f"ticket_{v}")]
    return df.groupBy(dim).agg(*columns, F.sum(amount).alias("amount")).withColumn("severity", _share(F.col(f"amount_{fraud}"), F.col("amount")))


def _with_points(df: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """A group's percentiles beside its other measures; null keys are groups too."""
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{k}"))
    return df.join(points.withColumnsRenamed({c: f"__p{k}" for k, c in enumerate(by)}), same, "left").drop(*[f"__p{k}" for k in range(len(by))])


def stats_by_indicator(df: DataFrame, indicator: str, variables: Sequence[str]) -> DataFrame:
    """Mean, median and 90th percentile of each variable by indicator: one unpivot."""
    long = df.select(indicator, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot([indicator], list(variables), "variable", "value")
    counts = value_counts(long, ["variable", indicator], "value")
    means = counts.groupBy("variable", indicator).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _share(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean"))
    points = group_percentiles(counts, ["variable", indicator], (0.5, 0.9), "p")
    return _with_points(means, points, ["variable", indicator]).select("variable", indicator, "n", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"))


def summary_by_period(df: DataFrame, period: Column, amount: str, fraud: Column, indicator: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """n, amount, frauds, fraud amount, ticket and fraud rate of each period, and a row TOTAL; for each of the indicator's values
    n, amount and ticket too (0 where the period has no such row)."""
    own = df.select(period.alias("period"), F.col(amount).alias("x"), F.coalesce(fraud.cast("int"), F.lit(0)).alias("f"), *([F.col(indicator).alias("i")] if indicator else []))
    parts = []
    for v in values if indicator else ():
        here = F.col("i") == v
        parts += [F.count(F.when(here, 1)).alias(f"n_{v}"), F.coalesce(F.sum(F.when(here, F.col("x"))), F.lit(0.0)).alias(f"amount_{v}"), F.coalesce(F.avg(F.when(here, F.col("x"))), F.lit(0.0)).alias(f"ticket_{v}")]
    out = own.rollup("period").agg(F.grouping("period").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("amount"), F.sum("f").alias("frauds"), F.coalesce(F.sum(F.when(F.col("f") == 1, F.col("x"))), F.lit(0.0)).alias("fraud_amount"), *parts)
    named = [f"{c}_{v}" for v in values for c in ("n", "amount", "ticket")] if indicator else []
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("period")).alias("period"), "n", "amount", "frauds", "fraud_amount", _share(F.col("amount"), F.col("n")).alias("ticket"), _share(F.col("frauds"), F.col("n")).alias("fraud_rate"), *named)


def cross_tab(df: DataFrame, a: str, b: str, fraud: Column) -> DataFrame:
    """n, frauds and rate for each pair of values, in long form."""
    out = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(fraud.cast("int"), F.lit(0))).alias("frauds"))
    return out.withColumn("rate", _share(F.col("frauds"), F.col("n")))


POINTS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def amount_stats(df: DataFrame, by: Sequence[str], amount: str, points: Sequence[float] = POINTS) -> DataFrame:
    """n, sum, mean, deviation, min, max and exact percentiles of each group."""
    out = df.groupBy(*by).agg(F.count(amount).alias("n"), F.sum(amount).alias("sum"), F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("std"), F.min(amount).alias("min"), F.max(amount).alias("max"))
    out = _with_points(out, group_percentiles(value_counts(df, by, amount), by, points, "p"), by)
    return out.select(*by, "n", "sum", "mean", "std", "min", "max", *[F.col("p")[k].alias(f"p{round(x * 100)}") for k, x in enumerate(points)])


def with_quantiles(df: DataFrame, value: str, q: int = 10, by: Sequence[str] = (), name: str = "decile", exact: bool = True) -> DataFrame:
    """Each row's quantile bucket from 1, of all rows or of its group. exact=False estimates the edges."""
    points = [k / q for k in range(q + 1)]
    if exact:
        found = group_percentiles(value_counts(df, by, value), by, points, "__edges") if by else percentiles(df, value, points, "__edges")
    else:
        edges = F.percentile_approx(value, F.array(*map(F.lit, points)), 10000).cast("array<double>").alias("__edges")
        found = df.groupBy(*by).agg(edges) if by else df.agg(edges)
    out = _with_points(df, found, by) if by else df.crossJoin(F.broadcast(found))  # one row
    return out.withColumn(name, quantile_bucket(F.col(value), F.col("__edges"))).drop("__edges")


def decile_table(df: DataFrame, value: str, fraud: Column, by: Sequence[str] = (), q: int = 10, medians: bool = True) -> DataFrame:
    """n, sum, min, max, median, frauds and rate of each quantile bucket: all from one written table of distinct values and counts.

    medians=False leaves the median out, which takes a second search for percentiles."""
    counts = value_counts(df.withColumn("__f", F.coalesce(fraud.cast("int"), F.lit(0))), by, value, F.sum("__f").alias("f")).filter("x is not null")
    counts = written(counts, "counts")  # read for edges and for buckets
    edges = group_percentiles(counts, by, [k / q for k in range(q + 1)], "__edges", stored=True)
    own = (_with_points(counts, edges, by) if by else counts.crossJoin(F.broadcast(edges))).withColumn("decile", quantile_bucket(F.col("x"), F.col("__edges"))).drop("__edges")
    own = written(own, "buckets") if medians else own  # read for sums and for medians
    keys = [*by, "decile"]
    out = own.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("sum"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("f").alias("frauds"))
    out = out.withColumn("rate", _share(F.col("frauds"), F.col("n")))
    if not medians:
        return out.select(*keys, "n", "sum", "min", "max", "frauds", "rate")
    out = _with_points(out, group_percentiles(own, keys, [0.5], "__m", stored=True), keys)
    return out.withColumn("median", F.col("__m")[0]).select(*keys, "n", "sum", "min", "max", "median", "frauds", "rate")


def optimal_range(df: DataFrame, value: str, fraud: Column, points: Sequence[float] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Percentiles of the frauds' values, and the share of other rows at or below each."""
    f = F.coalesce(fraud.cast("boolean"), F.lit(False))
    cuts = F.broadcast(percentiles(df, F.when(f, F.col(value)), points, "__c"))  # one row
    out = df.crossJoin(cuts).agg(F.count(F.when(~f & F.col(value).isNotNull(), 1)).alias("others"), F.first("__c").alias("c"), *[F.count(F.when(~f & (F.col(value) <= F.col("__c")[k]), 1)).alias(f"b{k}") for k in range(len(points))])
    rows = F.array(*[F.struct(F.lit(p).alias("point"), F.col("c")[k].alias("cut"), _share(F.col(f"b{k}"), F.col("others")).alias("others_below")) for k, p in enumerate(points)])
    return out.select(F.explode(rows).alias("r")).select("r.*")


def band_table(df: DataFrame, value: str, bands: Sequence[tuple[float, float, str]], fraud: Column, amber: float = 0.01, red: float = 0.03, by: Sequence[str] = ()) -> DataFrame:
    """n, frauds, rate and traffic light of each band [low, high): a join on a short list of ranges."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, float(a), float(b), n) for k, (a, b, n) in enumerate(bands)], "band_order int, low double, high double, band string"))
    own = df.select(*by, F.col(value).alias("__x"), F.coalesce(fraud.cast("int"), F.lit(0)).alias("__f"))
    out = own.join(table, (F.col("__x") >= F.col("low")) & (F.col("__x") < F.col("high"))).groupBy(*by, "band_order", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("frauds"))
    rate = _share(F.col("frauds"), F.col("n"))
    return out.withColumns({"rate": rate, "light": F.when(rate >= red, "red").when(rate >= amber, "amber").otherwise("green")})


def amount_interaction(df: DataFrame, dim: str, amount: str, fraud: Column, least: int = 2) -> DataFrame:
    """Median and 90th percentile of frauds and of others in each category with enough frauds, and their ratio."""
    f = F.coalesce(fraud.cast("boolean"), F.lit(False))
    own = df.select(dim, f.alias("__f"), F.col(amount).cast("double").alias("__x"))
    points = group_percentiles(value_counts(own, [dim, "__f"], "__x"), [dim, "__f"], (0.5, 0.9), "p").groupBy(dim).agg(F.max(F.when(F.col("__f"), F.col("p"))).alias("a"), F.max(F.when(~F.col("__f"), F.col("p"))).alias("b"))
    frauds = own.groupBy(dim).agg(F.count(F.when(F.col("__f"), 1)).alias("frauds")).filter(F.col("frauds") >= least)
    out = _with_points(frauds, points, [dim])
    out = out.select(dim, "frauds", F.col("a")[0].alias("median_fraud"), F.col("a")[1].alias("p90_fraud"), F.col("b")[0].alias("median_other"), F.col("b")[1].alias("p90_other"))
    r = _share(F.col("median_fraud"), F.col("median_other"))
    return out.withColumns({"ratio": r, "reading": F.when(r >= 1.5, "frauds larger").when(r <= 0.67, "frauds smaller").otherwise("alike")})


def bin_centric(df: DataFrame, bin_: str, amount: str, fraud: Column, modes: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` BINs by rows: n, frauds, amounts of frauds, and the most frequent value of each column in ``modes``."""
    f = F.coalesce(fraud.cast("int"), F.lit(0))
    out = df.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.sum(f).alias("frauds"), F.avg(F.when(f == 1, F.col(amount))).alias("mean_fraud"), F.max(F.when(f == 1, F.col(amount))).alias("max_fraud"), *[F.mode(m, True).alias(f"mode_{m}") for m in modes])
    return out.orderBy(F.desc("n"), bin_).limit(top)


def top_decile_opening(df: DataFrame, amount: str, fraud: Column, points: Sequence[float] = (0.9, 0.95, 0.97, 0.99, 1.0)) -> DataFrame:
    """The top decile cut at the given percentiles: band, n, amount, frauds."""
    cuts = F.broadcast(percentiles(df, amount, points, "__c"))  # one row
    x, band = F.col(amount), F.lit(None).cast("string")
    for k in range(len(points) - 2, -1, -1):
        inside = (x > F.col("__c")[k]) & (x <= F.col("__c")[k + 1])
        band = F.when(inside, F.lit(f"p{round(points[k] * 100)}-p{round(points[k + 1] * 100)}")).otherwise(band)
    own = df.withColumn("__f", F.coalesce(fraud.cast("int"), F.lit(0))).crossJoin(cuts).withColumn("band", band).filter("band is not null")
    return own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.sum("__f").alias("frauds"))


def group_summary(df: DataFrame, dims: Sequence[str], client: str, amount: str, fraud: Column, top: int = 50, least: int = 1) -> DataFrame:
    """n, frauds, rate, lift against all rows, clients, amounts, severity, ticket; the ``top`` groups by frauds, then rows."""
    own = df.select(*dims, F.col(client).alias("__c"), F.col(amount).alias("__x"), F.coalesce(fraud.cast("int"), F.lit(0)).alias("__f"))
    overall = F.broadcast(own.agg(F.avg("__f").alias("__rate")))  # one row
    out = own.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("frauds"), F.countDistinct("__c").alias("clients"), F.sum("__x").alias("amount"), F.coalesce(F.sum(F.when(F.col("__f") == 1, F.col("__x"))), F.lit(0.0)).alias("fraud_amount")).filter(F.col("n") >= least)
    rate = _share(F.col("frauds"), F.col("n"))
    out = out.crossJoin(overall).withColumns({"rate": rate, "lift": _share(rate, F.col("__rate")), "severity": _share(F.col("fraud_amount"), F.col("amount")), "ticket": _share(F.col("amount"), F.col("n"))}).drop("__rate")
    return out.orderBy(F.desc("frauds"), F.desc("n"), *dims).limit(top)


def decline_reasons(df: DataFrame, reason: str, client: str, amount: str, code: str | None = None, top: int | None = None) -> DataFrame:
    """Rows, amounts and clients by reason (and code)."""
    keys = [reason] + ([code] if code else [])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.countDistinct(client).alias("clients"))
    return out.orderBy(F.desc("n"), *keys).limit(top) if top else out


def day_heatmap(df: DataFrame, key: str, ts: str, top: int = 15) -> DataFrame:
    """Counts by day of the ``top`` keys, in long form."""
    daily = df.filter(F.col(key).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    best = daily.groupBy(key).agg(F.sum("n").alias("__n")).orderBy(F.desc("__n"), key).limit(top)
    return daily.join(F.broadcast(best), key).drop("__n")


def ranked_counts(df: DataFrame, group: str, item: str, amount: Column | None = None) -> DataFrame:
    """Sums by group and item with their dense rank in the group."""
    out = df.groupBy(group, item).agg((F.sum(amount) if amount is not None else F.count(F.lit(1))).alias("n"))
    return out.withColumn("rank", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("n"))))


def log_counts(df: DataFrame, path: str, day: str, group: str, item: str, empty: str = "NO_VALUE") -> None:
    """Append the day's rows by group and item to the log at ``path``; a rerun of a day replaces that day. Null items count as ``empty``."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group"), F.trim(F.coalesce(F.col(item).cast("string"), F.lit(empty))).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    write_table(counts.withColumn("day", F.lit(day)), path, ["day"])


def ranked_log(spark: SparkSession, path: str) -> DataFrame:
    """Totals of all logged days by group and item, days with the item, and the dense rank in the group."""
    log = spark.read.schema("`group` string, item string, n bigint, day string").parquet(path)
    out = log.groupBy("group", "item").agg(F.sum("n").alias("total"), F.countDistinct("day").alias("days"))
    return out.withColumn("rank", F.dense_rank().over(Window.partitionBy("group").orderBy(F.desc("total"))))


def claims_by(df: DataFrame, dims: Sequence[str], amount: str, delay: str) -> DataFrame:
    """Claims of each value of each dimension: n (rows with an amount), total and mean amount, share of all rows, median delay.

    One unpivot for all dimensions, added up by distinct delay before the shuffle's groups are put together; medians come from
    running totals over ranges, so a value that holds most rows is no single task's. Null values of a dimension are left out."""
    rows = df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col(amount).cast("double").alias("__amount"), F.col(delay).cast("double").alias("__delay"))
    long = rows.unpivot(["__amount", "__delay"], list(dims), "dimension", "value").filter(F.col("value").isNotNull())
    counts = value_counts(long, ["dimension", "value"], "__delay", F.count(F.lit(1)).alias("rows"), F.count("__amount").alias("paid"), F.sum("__amount").alias("amount"))
    every = F.broadcast(df.agg(F.count(F.lit(1)).alias("__all")))  # one row
    sums = counts.groupBy("dimension", "value").agg(F.sum("paid").alias("n"), F.sum("amount").alias("amount"), F.sum("rows").alias("__rows"))
    points = group_percentiles(counts, ["dimension", "value"], (0.5,), "p")
    out = _with_points(sums, points, ["dimension", "value"]).crossJoin(every)
    return out.select("dimension", "value", "n", "amount", _share(F.col("amount"), F.col("n")).alias("mean"), _share(F.col("__rows"), F.col("__all")).alias("share"), F.col("p")[0].alias("median_delay"))


def share_of_total(df: DataFrame, dims: Sequence[str], measure: Column, within: Sequence[str] = ()) -> DataFrame:
    """The measure of each group, its share of all, and its share within the groups of ``within``."""
    out = df.groupBy(*dims).agg(measure.alias("value"))
    total = F.broadcast(out.agg(F.sum("value").alias("__t")))
    out = out.crossJoin(total).withColumn("share", _share(F.col("value"), F.col("__t"))).drop("__t")
    return out.withColumn("share_within", _share(F.col("value"), F.sum("value").over(Window.partitionBy(*within)))) if within else out


def top_concentration(df: DataFrame, key: str, amount: str, top: int = 10) -> DataFrame:
    """Share of the amount that the ``top`` keys hold."""
    sums = df.groupBy(key).agg(F.sum(amount).alias("x"))
    best = sums.orderBy(F.desc("x"), key).limit(top).agg(F.sum("x").alias("top_amount"))
    return best.crossJoin(sums.agg(F.sum("x").alias("amount"))).withColumn("concentration", _share(F.col("top_amount"), F.col("amount")))


def month_over_month(df: DataFrame, ts: str, measure: Column) -> DataFrame:
    """The measure of each month, of the month before, and the change."""
    out = df.groupBy(F.date_format(F.trunc(F.col(ts), "month"), "yyyy-MM").alias("month"), F.trunc(F.col(ts), "month").alias("__m")).agg(measure.alias("value"))
    before = out.select(F.add_months("__m", 1).alias("__m"), F.col("value").alias("previous"))
    return out.join(before, "__m", "left").drop("__m").withColumn("change", _share(F.col("value") - F.col("previous"), F.col("previous")))


def peak_bucket(df: DataFrame, bucket: Column, condition: Column) -> DataFrame:
    """The bucket with the most rows that meet the condition; the smallest of several."""
    counts = df.filter(condition).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "bucket").limit(1)


def mean_of_group_measures(df: DataFrame, key: str, measure: Column) -> DataFrame:
    """Mean over the keys of a measure taken for each key."""
    return df.groupBy(key).agg(measure.alias("m")).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("keys"))


def conditional_ratios(df: DataFrame, flag: Column, card: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows, of cards and of the amount with a flag."""
    f = F.coalesce(flag.cast("boolean"), F.lit(False))
    return df.groupBy(*by).agg(F.avg(f.cast("double")).alias("row_share"), _share(F.countDistinct(F.when(f, F.col(card))), F.countDistinct(card)).alias("card_share"), _share(F.coalesce(F.sum(F.when(f, F.col(amount))), F.lit(0.0)), F.sum(amount)).alias("amount_share"))


def base_measures(df: DataFrame, card: str, merchant: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.countDistinct(card).alias("cards"), F.countDistinct(merchant).alias("merchants"), F.avg(amount).alias("ticket"))


def approval_matrix(df: DataFrame, bin_: str, approved: Column, code: str, amount: str, fraud: Column, codes: Sequence[str] = ("59", "63"), original: str | None = None, currencies: Mapping[str, str] = {}) -> DataFrame:
    """Approved and declined rows, rates, chosen response codes, frauds, and amounts by approval for each BIN.

    ``currencies`` gives for each currency its amount column; a row is in the currency whose amount equals the ``original`` one
    (in several, if several do), and adds to approved_<currency> or declined_<currency>."""
    ok, f = F.coalesce(approved.cast("boolean"), F.lit(False)), F.coalesce(fraud.cast("int"), F.lit(0))
    n = F.count(F.lit(1))
    total = lambda where, column: F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0.0))
    money = [total(side & (F.col(original) == F.col(c)), c).alias(f"{name}_{currency}") for currency, c in currencies.items() for name, side in (("approved", ok), ("declined", ~ok))] if original else []
    return df.groupBy(bin_).agg(
        n.alias("n"), F.count(F.when(ok, 1)).alias("approved"), F.count(F.when(~ok, 1)).alias("declined"), F.avg(ok.cast("double")).alias("approval_rate"), F.avg((~ok).cast("double")).alias("decline_rate"),
        *[F.count(F.when(F.col(code) == c, 1)).alias(f"code_{c}") for c in codes], F.sum(f).alias("frauds"),
        total(ok, amount).alias("approved_amount"), total(~ok, amount).alias("declined_amount"), *money,
    )


def case_closing(df: DataFrame, opened: str, closed: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean days to close, share closed within 1 and 7 days, pending amount."""
    days = F.date_diff(F.to_date(closed), F.to_date(opened))
    return df.groupBy(*by).agg(F.avg(days).alias("mean_days"), F.avg(F.when(days.isNotNull(), (days <= 1).cast("double"))).alias("within_day"), F.avg(F.when(days.isNotNull(), (days <= 7).cast("double"))).alias("within_week"), F.coalesce(F.sum(F.when(F.col(closed).isNull(), F.col(amount))), F.lit(0.0)).alias("pending_amount"))


def flag_lift(df: DataFrame, dims: Sequence[str], fraud: Column, least: int = 20) -> DataFrame:
    """n, frauds, rate of each value of each dimension with at least ``least`` rows: one unpivot."""
    own = df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.coalesce(fraud.cast("int"), F.lit(0)).alias("__f"))
    out = own.unpivot(["__f"], list(dims), "dimension", "value").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("frauds")).filter(F.col("n") >= least)
    return out.withColumn("rate", _share(F.col("frauds"), F.col("n")))


def card_testing_days(df: DataFrame, prefix: str, ts: str, card: str, top: int = 10, least: int = 2) -> DataFrame:
    """The days with the most card ranges on which at least ``least`` cards were active."""
    daily = df.filter(F.col(prefix).isNotNull()).groupBy(F.to_date(ts).alias("day"), prefix).agg(F.countDistinct(card).alias("cards")).filter(F.col("cards") >= least)
    return daily.groupBy("day").agg(F.count(F.lit(1)).alias("ranges"), F.max("cards").alias("most_cards")).orderBy(F.desc("ranges"), "day").limit(top)


def cards_per_range(df: DataFrame, prefix: str, ts: str, card: str, least: int = 2) -> DataFrame:
    """How many cards share a range and day: for each such number from ``least`` on, the rows and the ranges and days that have it."""
    daily = df.filter(F.col(prefix).isNotNull()).groupBy(F.to_date(ts).alias("day"), prefix).agg(F.countDistinct(card).alias("cards"), F.count(F.lit(1)).alias("n"))
    return daily.filter(F.col("cards") >= least).groupBy("cards").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("range_days"))


def ranges_by_rate(df: DataFrame, bin_: str, fraud: Column, amount: str, top: int = 5, least: int = 10) -> DataFrame:
    """The BINs with the highest fraud rate (in percent, to two places) among those with at least ``least`` amounts; the smaller BIN first of several."""
    out = df.filter(F.col(bin_).isNotNull()).groupBy(bin_).agg(F.count(amount).alias("n"), F.sum(F.coalesce(fraud.cast("int"), F.lit(0))).alias("frauds"))
    out = out.filter(F.col("n") >= least).withColumn("rate", F.round(100 * _share(F.col("frauds"), F.col("n")), 2))
    return out.orderBy(F.desc("rate"), bin_).limit(top)


def merchant_detail(df: DataFrame, merchant: str, ts: str, card: str, amount: str, fraud: Column, burst: Column) -> DataFrame:
    """Days with fraud, smallest and largest ticket, burst share, cards, frauds per card."""
    f = F.coalesce(fraud.cast("int"), F.lit(0))
    return df.groupBy(merchant).agg(F.countDistinct(F.when(f == 1, F.to_date(ts))).alias("fraud_days"), F.min(amount).alias("min_ticket"), F.max(amount).alias("max_ticket"), F.avg(F.coalesce(burst.cast("double"), F.lit(0.0))).alias("burst_share"), F.countDistinct(card).alias("cards"), _share(F.sum(f), F.countDistinct(card)).alias("frauds_per_card"))


def client_day_buckets(df: DataFrame, client: str, ts: str, indicator: str, most: int = 6) -> DataFrame:
    """Rows of a client, day and indicator, clipped: rows and clients of each bucket, share of the indicator's rows."""
    daily = df.filter(F.col(client).isNotNull()).groupBy(client, F.to_date(ts).alias("day"), indicator).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("n") >= most, f"{most}+").otherwise(F.col("n").cast("string"))
    out = daily.groupBy(indicator, bucket.alias("bucket")).agg(F.sum("n").alias("rows"), F.countDistinct(client).alias("clients"))
    return out.withColumn("share", _share(F.col("rows"), F.sum("rows").over(Window.partitionBy(indicator))))


def daily_median(df: DataFrame, ts: str, score: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.percentile(score, F.lit(0.5)).alias("median"), F.count(score).alias("n"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def steady_sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """The same n rows each time: those with the smallest hash of id and seed."""
    return df.orderBy(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"-{seed}"))), row_id).limit(n)


def ordered_by_map(df: DataFrame, column: str, order: Mapping[str, int], then: Sequence[Column] = ()) -> DataFrame:
    """Sorted by a custom order of a column's values; unknown values last."""
    key = F.lit(len(order))
    for value, k in order.items():
        key = F.when(F.col(column) == value, F.lit(k)).otherwise(key)
    return df.orderBy(key, *then)


def next_numbers(df: DataFrame, order: Sequence[str], stored: DataFrame, number: str) -> DataFrame:
    """Running numbers that go on from the largest stored one (from 1 where nothing is stored)."""
    return numbered(df, order, stored.agg(F.max(number)).first()[0] or 0)


def month_to_date(df: DataFrame, ts: str, measure: Column) -> DataFrame:
    """One row: the measure from the first of the last day's month to that day, the same days of the month before, and the change."""
    day = F.to_date(ts)
    last = F.broadcast(df.agg(F.max(day).alias("last_day")))  # one row
    own = df.crossJoin(last).withColumn("__back", F.add_months("last_day", -1))
    part = F.when(day >= F.trunc("last_day", "month"), "now").when((day >= F.trunc("__back", "month")) & (day <= F.col("__back")), "before")
    sums = own.withColumn("__part", part).filter("__part IS NOT NULL").groupBy("last_day", "__part").agg(measure.alias("__m"))
    pick = lambda k: F.max(F.when(F.col("__part") == k, F.col("__m")))
    out = sums.groupBy("last_day").agg(pick("now").alias("month_to_date"), pick("before").alias("previous"))
    return out.withColumn("change", F.col("month_to_date") / F.nullif(F.col("previous").cast("double"), F.lit(0.0)) - 1)


def lift_of_flags(df: DataFrame, flags: Sequence[str], fraud: Column) -> DataFrame:
    """flag, n, frauds, rate and lift (rate by the rate of all rows) of each 0/1 flag: one scan."""
    f = F.coalesce(fraud.cast("int"), F.lit(0))
    sums = df.agg(F.avg(f).alias("__all"), *[x for c in flags for x in (F.count(F.when(F.col(c) == 1, 1)).alias(f"n_{c}"), F.coalesce(F.sum(F.when(F.col(c) == 1, f)), F.lit(0)).alias(f"f_{c}"))])
    out = sums.select("__all", F.inline(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"n_{c}").alias("n"), F.col(f"f_{c}").alias("frauds")) for c in flags])))
    out = out.withColumn("rate", _share(F.col("frauds"), F.col("n")))
    return out.withColumn("lift", F.col("rate") / F.nullif(F.col("__all"), F.lit(0.0))).drop("__all")


def flag_by_group(df: DataFrame, keys: Sequence[str], flag: str, fraud: Column, least: int = 1) -> DataFrame:
    """Of each group with at least ``least`` flagged rows: rows, flagged rows, their share, frauds among them and their rate."""
    f, hit = F.coalesce(fraud.cast("int"), F.lit(0)), F.col(flag) == 1
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("flagged"), F.coalesce(F.sum(F.when(hit, f)), F.lit(0)).alias("frauds"))
    return out.filter(F.col("flagged") >= least).withColumns({"share": _share(F.col("flagged"), F.col("n")), "rate": _share(F.col("frauds"), F.col("flagged"))})


def top_decile_cards(df: DataFrame, card: str, amount: str, fraud: Column, top: int = 20, point: float = 0.9) -> DataFrame:
    """The cards with the most above the percentile: rows, amount and frauds there."""
    cut = F.broadcast(percentiles(df, amount, [point], "__c"))  # one row
    own = df.crossJoin(cut).filter(F.col(amount) > F.col("__c")[0])
    out = own.groupBy(card).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.sum(F.coalesce(fraud.cast("int"), F.lit(0))).alias("frauds"))
    return out.orderBy(F.desc("amount"), card).limit(top)

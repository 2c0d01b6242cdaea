"""Daily series of keys, their gaps filled, and anomalies in them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_series(df: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, Column]) -> DataFrame:
    """keys, day and the measures (aggregates) of each day; rows with a null key are left out."""
    known = df.dropna(subset=list(keys)) if keys else df
    return known.groupBy(*keys, F.to_date(ts).alias("day")).agg(*[c.alias(n) for n, c in measures.items()])


def transaction_measures(card: str, amount: str, approved: Column, merchant: str, mcc: str, ts: str) -> dict[str, Column]:
    """The usual measures of a card range and day."""
    ok, n = F.coalesce(approved.cast("boolean"), F.lit(False)), F.count(F.lit(1))
    return {
        "n_trx": n, "n_cards": F.countDistinct(card), "trx_per_card": n / F.nullif(F.countDistinct(card), F.lit(0)), "decline_rate": F.avg((~ok).cast("double")), "mean_ticket": F.avg(F.when(ok, F.col(amount))),
        "approved_amount": F.coalesce(F.sum(F.when(ok, F.col(amount))), F.lit(0.0)), "n_mcc": F.countDistinct(mcc), "n_merchants": F.countDistinct(merchant), "night_share": F.avg((F.hour(ts) < 6).cast("double")),
    }


def densify(series: DataFrame, keys: Sequence[str], zeros: Sequence[str], day: str = "day") -> DataFrame:
    """A row for each day from the series' first to the last day of all series; ``zeros`` are 0 on added days, others null."""
    last = series.agg(F.max(day).alias("__last"))
    spans = series.groupBy(*keys).agg(F.min(day).alias("__first")).crossJoin(F.broadcast(last))  # one row
    days = spans.select(*keys, F.explode(F.sequence("__first", "__last", F.expr("interval 1 day"))).alias(day))
    return days.join(series, [*keys, day], "left").na.fill(0, list(zeros))


def robust_z(series: DataFrame, keys: Sequence[str], value: str, day: str = "day", window: int = 21, least: int = 7, z: float = 4.0, volume: float = 10.0) -> DataFrame:
    """Median and MAD of the previous ``window`` days, robust z and alert.

    z = 0.6745 (x - median) / max(MAD, 1); null with fewer than ``least`` days before. Alert: z above the limit, the value at
    least ``volume`` and above the median.
    """
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-window, -1)
    enough = F.count(value).over(w) >= least
    out = series.withColumns({"median": F.when(enough, F.percentile(value, F.lit(0.5)).over(w)), "__held": F.collect_list(F.col(value).cast("double")).over(w)})
    off = F.array_sort(F.transform("__held", lambda v: F.abs(v - F.col("median"))))
    n = F.size(off)
    mad = (F.try_element_at(off, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(off, F.floor((n + 2) / 2).cast("int"))) / 2
    out = out.withColumn("mad", F.when(F.col("median").isNotNull(), mad)).drop("__held")
    out = out.withColumn("z", 0.6745 * (F.col(value) - F.col("median")) / F.greatest("mad", F.lit(1.0)))
    return out.withColumn("alert", F.coalesce((F.col("z") > z) & (F.col(value) >= volume) & (F.col(value) > F.col("median")), F.lit(False)).cast("int"))


def multi_level(df: DataFrame, levels: Mapping[str, Sequence[str]], ts: str, measures: Mapping[str, Column], value: str, zeros: Sequence[str], **limits) -> DataFrame:
    """robust_z of several key lists at once: level, key (readable), day, the measures, median, mad, z, alert."""
    out = None
    for level, keys in levels.items():
        scored = robust_z(densify(daily_series(df, keys, ts, measures), keys, zeros), keys, value, **limits)
        part = scored.select(F.lit(level).alias("level"), F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys]).alias("key"), "day", *measures, "median", "mad", "z", "alert")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def rolling_z(series: DataFrame, keys: Sequence[str], values: Sequence[str], day: str = "day", window: int = 30, least: int = 3, limit: float = 2.0) -> DataFrame:
    """Mean and deviation z of the values against the previous ``window`` days, on each series' rows of the last day of all."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-window, -1)
    scored = series.withColumns({f"z_{v}": F.when(F.count(v).over(w) >= least, (F.col(v) - F.avg(v).over(w)) / F.nullif(F.stddev_samp(v).over(w), F.lit(0.0))) for v in values})
    last = F.broadcast(series.agg(F.max(day).alias(day)))  # one row
    top = F.greatest(*[F.abs(F.coalesce(F.col(f"z_{v}"), F.lit(0.0))) for v in values], F.lit(0.0))
    return scored.join(last, day).withColumn("max_z", top).withColumn("alert", (F.col("max_z") > limit).cast("int"))


def trailing(df: DataFrame, day: str, days: int, before: int = 0) -> DataFrame:
    """Rows of the last ``days`` days up to the latest day; with ``before``, also period 'recent' or 'baseline' (the days before)."""
    last = F.broadcast(df.agg(F.max(F.to_date(day)).alias("__last")))  # one row
    age = F.date_diff(F.col("__last"), F.to_date(day))
    out = df.crossJoin(last).filter(age < days + before)
    return (out.withColumn("period", F.when(age < days, "recent").otherwise("baseline")) if before else out).drop("__last")


def latest_per_group(df: DataFrame, group: str, day: str, measures: Mapping[str, Column]) -> DataFrame:
    """The measures of each group's own last day."""
    daily = df.groupBy(group, F.to_date(day).alias("day")).agg(*[c.alias(n) for n, c in measures.items()])
    return daily.groupBy(group).agg(F.max("day").alias("day"), *[F.max_by(n, "day").alias(n) for n in measures])


def spike_vs_median(series: DataFrame, key: str, value: str, times: float = 3.0, top: int = 15, day: str = "day") -> DataFrame:
    """Days above ``times`` the median of the key's active days, for the ``top`` keys by total."""
    active = series.filter(F.col(value) > 0)
    keys = active.groupBy(key).agg(F.sum(value).alias("__total"), F.percentile(value, F.lit(0.5)).alias("median")).orderBy(F.desc("__total"), key).limit(top)
    return active.join(F.broadcast(keys), key).filter(F.col(value) > times * F.col("median")).select(key, day, value, "median", (F.col(value) / F.col("median")).alias("ratio"))


def spike_detectors(df: DataFrame, key: str, ts: str, amount: str, days: int = 7, before: int = 60, times: float = 3.0, sigmas: float = 2.0, least: int = 3) -> DataFrame:
    """Merchants of the recent days against the baseline: ghost (new), volume spike, amount jump; ratio 999 without a baseline."""
    t = trailing(df.filter(F.col(key).isNotNull()), ts, days, before)
    recent, base = F.col("period") == "recent", F.col("period") == "baseline"
    g = t.groupBy(key).agg(
        F.count(F.when(recent, 1)).alias("n_recent"), F.count(F.when(base, 1)).alias("n_base"), F.avg(F.when(recent, F.col(amount))).alias("mean_recent"),
        F.avg(F.when(base, F.col(amount))).alias("mean_base"), F.stddev_samp(F.when(base, F.col(amount))).alias("std_base"),
    ).filter("n_recent > 0")
    daily = F.col("n_base") / before
    flags = {
        "volume_ratio": F.when(F.col("n_base") > 0, F.col("n_recent") / days / daily).otherwise(999.0),
        "is_ghost": (F.col("n_base") == 0).cast("int"),
        "is_volume_spike": ((F.col("n_base") > 0) & (F.col("n_recent") / days >= times * daily) & (F.col("n_recent") >= 2)).cast("int"),
        "is_amount_jump": F.coalesce((F.col("n_base") >= least) & (F.col("mean_recent") > F.col("mean_base") + sigmas * F.col("std_base")), F.lit(False)).cast("int"),
    }
    return g.withColumns(flags)


def calendar_dimension(df: DataFrame, day: str) -> DataFrame:
    """Every date from the first to the last day with its parts; the fiscal year begins in November."""
    ends = df.agg(F.min(F.to_date(day)).alias("a"), F.max(F.to_date(day)).alias("b"))
    d = F.col("date")
    dates = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return dates.select("date", F.year(d).alias("year"), F.month(d).alias("month"), F.weekofyear(d).alias("iso_week"), F.when(F.dayofmonth(d) <= 15, "Q1").otherwise("Q2").alias("fortnight"), (F.year(d) + (F.month(d) >= 11).cast("int")).alias("fiscal_year"))


def with_events(df: DataFrame, day: str, events: DataFrame, name: str = "event", separator: str = " + ") -> DataFrame:
    """Rows with the names, in order, of all events (first, last, name) whose days hold theirs; null for none.

    Events are spread over their days, so the join is one on equal days, not a comparison of all rows with all events.
    """
    days = events.select(F.explode(F.sequence(F.col("first").cast("date"), F.col("last").cast("date"))).alias("__day"), "name")
    labels = days.groupBy("__day").agg(F.concat_ws(separator, F.array_sort(F.collect_set("name"))).alias(name))
    return df.withColumn("__day", F.to_date(day)).join(labels, "__day", "left").drop("__day")

"""What made an alert: shares of the excess, shifts of the mix, priority. All alerts at once, no loop over them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.calendar import Calendar, event_label
from ..sources.scratch import written


def with_baseline(alerts: DataFrame, detail: DataFrame, keys: Sequence[str], ts: str, day: str = "day", window: int = 21) -> DataFrame:
    """Rows of each alert's keys on its day and on the ``window`` days before, with column is_day."""
    a = alerts.select(*keys, F.col(day).alias("alert_day")).distinct()
    d = F.to_date(ts)
    out = detail.join(a, list(keys)).filter((d <= F.col("alert_day")) & (d >= F.date_sub("alert_day", window)))
    return out.withColumn("is_day", (d == F.col("alert_day")).cast("int"))


def _counts(rows: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Day and baseline counts of each alert, dimension and category, and the number of baseline days."""
    alert = [*keys, "alert_day"]
    long = rows.select(*alert, "is_day", *[F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(f"dim_{d}") for d in dims]).unpivot([*alert, "is_day"], [f"dim_{d}" for d in dims], "dimension", "category")
    return long.groupBy(*alert, "dimension", "category").agg(F.sum("is_day").alias("n_day"), F.sum(1 - F.col("is_day")).alias("n_base")).withColumn("dimension", F.substring("dimension", 5, 99))


def share_of_excess(rows: DataFrame, keys: Sequence[str], dims: Sequence[str], window: int = 21) -> DataFrame:
    """For each alert, dimension and category of the day: its count beyond the baseline's daily mean, and the share of all such."""
    alert = [*keys, "alert_day", "dimension"]
    out = _counts(rows, keys, dims).filter("n_day > 0").withColumn("excess", F.greatest(F.lit(0.0), F.col("n_day") - F.col("n_base") / window))
    share = F.col("excess") / F.nullif(F.sum("excess").over(Window.partitionBy(*alert)), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(*alert).orderBy(F.desc("excess"), "category"))
    return out.withColumns({"share": share, "place": place})


def top_text(shares: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """'X (87%), Y (10%)' of the first k categories of each alert and dimension."""
    text = F.concat("category", F.lit(" ("), F.round(100 * F.coalesce("share", F.lit(0.0))).cast("int").cast("string"), F.lit("%)"))
    best = shares.filter(F.col("place") <= k).groupBy(*keys, "alert_day", "dimension").agg(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))).alias("x"))
    return best.select(*keys, "alert_day", "dimension", F.array_join("x.t", ", ").alias("top"))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution, by the finite sums for whole degrees of freedom."""
    if dof < 1 or x is None or math.isnan(x):
        return float("nan")
    half = x / 2
    if half <= 0:
        return 1.0
    odd = dof % 2 / 2
    terms = [k * math.log(half) - math.lgamma(k + 1) - half for k in (n + odd for n in range(dof // 2))]  # logarithms: no overflow
    total = math.fsum(map(math.exp, terms))
    return min(1.0, total + math.erfc(math.sqrt(half)) if odd else total)


@F.pandas_udf(DoubleType())
def _p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, dof in batches:
        yield pd.Series([None if pd.isna(a) or pd.isna(d) else chi2_tail(float(a), int(d)) for a, d in zip(x, dof)], dtype="float64")


def mix_shift(rows: DataFrame, keys: Sequence[str], dims: Sequence[str], least: int = 5) -> DataFrame:
    """Chi-square test of the day's mix against the baseline's, over categories with at least ``least`` rows.

    Continuity correction for one degree of freedom; null with fewer than two categories or an empty side.
    """
    alert = [*keys, "alert_day", "dimension"]
    kept = _counts(rows, keys, dims).filter(F.col("n_day") + F.col("n_base") >= least)
    w = Window.partitionBy(*alert)
    kept = kept.withColumns({"__d": F.sum("n_day").over(w), "__b": F.sum("n_base").over(w), "__k": F.count(F.lit(1)).over(w)})
    n, t = F.col("__d") + F.col("__b"), F.col("n_day") + F.col("n_base")

    def part(observed: str, side: str) -> Column:
        expected = t * F.col(side) / F.nullif(n, F.lit(0))
        off = F.abs(F.col(observed) - expected)
        off = F.when(F.col("__k") == 2, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
        return off * off / F.nullif(expected, F.lit(0.0))

    out = kept.groupBy(*alert).agg(F.sum(part("n_day", "__d") + part("n_base", "__b")).alias("x"), F.first("__k").alias("k"), F.first("__d").alias("d"), F.first("__b").alias("b"))
    good = (F.col("k") >= 2) & (F.col("d") > 0) & (F.col("b") > 0)
    out = out.select(*alert, F.when(good, F.col("x")).alias("chi2"), F.when(good, F.col("k") - 1).cast("int").alias("dof"))
    return out.withColumn("p_value", _p_value("chi2", "dof"))


def decline_jump(rows: DataFrame, keys: Sequence[str], approved: Column, times: float = 2.0, plus: float = 0.15) -> DataFrame:
    """Decline rates of day and baseline, and whether the day's is beyond both limits."""
    bad = (~F.coalesce(approved.cast("boolean"), F.lit(False))).cast("double")
    out = rows.groupBy(*keys, "alert_day").agg(F.avg(F.when(F.col("is_day") == 1, bad)).alias("rate_day"), F.avg(F.when(F.col("is_day") == 0, bad)).alias("rate_base"))
    limit = F.greatest(times * F.col("rate_base"), F.col("rate_base") + plus)
    return out.withColumn("is_decline_jump", F.coalesce(F.col("rate_day") > limit, F.lit(False)).cast("int"))


def priority(event: Column, p_value: Column, jump: Column, alpha: float = 0.01) -> Column:
    """HIGH: no known event, and a shifted mix or a decline jump; MEDIUM: no event, or one with a shift or jump; else LOW."""
    odd = F.coalesce(p_value < alpha, F.lit(False)) | (F.coalesce(jump, F.lit(0)) == 1)
    return F.when(event.isNull() & odd, "HIGH").when(event.isNull() | odd, "MEDIUM").otherwise("LOW")


def report(alerts: DataFrame, detail: DataFrame, keys: Sequence[str], ts: str, dims: Sequence[str], approved: Column, calendar: Calendar = Calendar(), window: int = 21, top: int = 10) -> dict[str, DataFrame]:
    """alerts (with event, smallest p-value, decline rates, priority), contributions (first ``top`` categories), series of the alerted keys, summary."""
    rows = written(with_baseline(alerts, detail, keys, ts, window=window), "baseline")  # read for shares, mix and declines
    shares = share_of_excess(rows, keys, dims, window)
    shift = mix_shift(rows, keys, dims).groupBy(*keys, "alert_day").agg(F.min("p_value").alias("p_value"))
    named = alerts.withColumnRenamed("day", "alert_day").join(shift, [*keys, "alert_day"], "left").join(decline_jump(rows, keys, approved), [*keys, "alert_day"], "left")
    named = named.withColumn("event", event_label(F.col("alert_day"), calendar))
    named = named.withColumn("priority", priority(F.col("event"), F.col("p_value"), F.col("is_decline_jump")))
    series = detail.join(alerts.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return {"alerts": named, "contributions": shares.filter(F.col("place") <= top), "series": series, "summary": named.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))}

"""Profiles of clients, cards, merchants and card ranges, and rows set against them.

Profiles are aggregates joined back on their keys, so a merchant or card range with a large share of the rows is summed
before anything is shuffled. Rows with a null key keep nulls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import exact_mean, exact_parts
from .quantiles import percentiles
from .ranges import numbered
from .velocity import key_parts, known, velocity


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def profile(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """The measures of each group; groups with a null key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def enrich(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Each row with the measures of its group."""
    return df.join(profile(df, keys, measures), list(keys), "left")


def activity(df: DataFrame, keys: Sequence[str], ts: str, amount: str, merchant: str) -> DataFrame:
    """Client or card profile: n, total, merchants, days, per_day, flags for repeated, multi-merchant and burst."""
    out = profile(df, keys, {"n": F.count(F.lit(1)), "total": F.sum(amount), "merchants": F.countDistinct(merchant), "days": F.countDistinct(F.to_date(ts))})
    per_day = F.col("n") / F.nullif(F.col("days"), F.lit(0))
    return out.withColumns({"per_day": per_day, "is_repeated": _flag(F.col("n") > 1), "is_multi_merchant": _flag(F.col("merchants") > 1), "is_burst": _flag(per_day >= 3)})


def merchant_profile(df: DataFrame, keys: Sequence[str], ts: str, amount: str, client: str, fraud: Column) -> DataFrame:
    """Totals, means, clients, days, frauds and fraud rate, rows a day, and positions by volume."""
    bad = F.coalesce(fraud.cast("int"), F.lit(0))
    units, rest = exact_parts(F.col(amount))
    mean = exact_mean(F.sum(units), F.sum(rest), F.count(amount))
    out = profile(df, keys, {"n": F.count(F.lit(1)), "total": F.sum(amount), "mean": mean, "clients": F.countDistinct(client), "days": F.countDistinct(F.to_date(ts)), "frauds": F.sum(bad)})
    out = out.withColumns({"fraud_rate": F.col("frauds") / F.col("n"), "per_day": F.col("n") / F.nullif(F.col("days"), F.lit(0))})
    ranked = numbered(out.withColumn("__down", -F.col("n")), ["__down", *keys])  # by ranges, no window over all merchants
    return ranked.withColumn("rank", F.col("number").cast("int")).drop("__down", "number")


def mule_accounts(df: DataFrame, account: str, card: str, least: int = 3) -> DataFrame:
    """Destination accounts reached by at least ``least`` cards."""
    return profile(df, [account], {"cards": F.countDistinct(card), "n": F.count(F.lit(1))}).filter(F.col("cards") >= least)


def merchant_novelty(df: DataFrame, key: str, ts: str, amount: str, new_days: int = 30, share: float = 0.8) -> DataFrame:
    """First and last day, months, age, new flag, and high impact in a short time by the percentile of totals."""
    out = profile(df, [key], {"first_day": F.min(F.to_date(ts)), "last_day": F.max(F.to_date(ts)), "months": F.countDistinct(F.trunc(F.col(ts), "month")), "total": F.sum(amount), "n": F.count(F.lit(1))})
    cut = percentiles(out, "total", [share], "__p").crossJoin(out.agg(F.max("last_day").alias("__end")))
    cut = F.broadcast(cut.select(F.col("__p")[0].alias("__cut"), "__end"))  # one row
    out = out.crossJoin(cut).withColumn("age_days", F.date_diff("last_day", "first_day"))
    return out.withColumns({"is_new": _flag(F.date_diff("__end", "first_day") <= new_days), "is_fast_impact": _flag((F.col("total") >= F.col("__cut")) & (F.col("age_days") <= new_days))}).drop("__cut", "__end")


def group_zscore(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.0, prefix: str = "") -> DataFrame:
    """z of the value in its group (a missing or zero deviation counts as 1), its difference and ratio to the mean, outlier flag."""
    stats = {"__mean": F.avg(value), "__std": F.stddev_samp(value)}
    out = enrich(df, keys, stats) if keys else df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])))
    std = F.coalesce(F.nullif(F.col("__std"), F.lit(0.0)), F.lit(1.0))
    z = (F.col(value) - F.col("__mean")) / std
    columns = {f"{prefix}z": z, f"{prefix}deviation": F.col(value) - F.col("__mean"), f"{prefix}ratio": F.col(value) / F.nullif(F.col("__mean"), F.lit(0.0)), f"{prefix}is_outlier": _flag(F.abs(z) > limit)}
    return out.withColumns(columns).drop("__mean", "__std")


def predominant(df: DataFrame, column: str, keys: Sequence[str], name: str = "predominant") -> DataFrame:
    """The most frequent value of the group (the smallest of several) and whether the row differs from it."""
    counts = df.dropna(subset=[*keys, column]).groupBy(*keys, column).count()
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("v"))).alias("__top")).select(*keys, F.col("__top.v").alias(name))
    return df.join(top, list(keys), "left").withColumn(f"is_unusual_{column}", _flag(F.col(column) != F.col(name)))


def distinct_per_day(df: DataFrame, keys: Sequence[str], ts: str, column: str, name: str, least: int = 2) -> DataFrame:
    """Distinct values of a column for the keys and day (cards of a card range, clients of a BIN), with a flag from ``least`` on."""
    out = enrich(df.withColumn("__day", F.to_date(ts)), [*keys, "__day"], {name: F.countDistinct(column)}).drop("__day")
    return out.withColumns({name: F.coalesce(name, F.lit(0)), f"is_{name}": _flag(F.col(name) >= least)})


def range_bursts(df: DataFrame, bin_: str, ts: str, row_id: str, amount: str, client: str, rows: int = 10, total: float = 5000.0, clients: int = 5) -> DataFrame:
    """A card range under attack: its earlier rows and amount in an hour and a day, its clients of the day, and a flag for each
    of many rows in the hour, a large amount in the day and many clients. Rows without a range get nulls and flags of 0."""
    out = distinct_per_day(velocity(df, [bin_], ts, row_id, amount, {"1h": 3600, "24h": 86400}), [bin_], ts, client, "clients_day", clients).withColumnRenamed("is_clients_day", "is_many_clients")
    return out.withColumns({"is_burst": _flag(F.col("n_1h") >= rows), "is_large_amount": _flag(F.col("sum_24h") >= total)})


def prefixes(card: Column, lengths: Sequence[int] = (6, 10, 11, 12)) -> dict[str, Column]:
    """Card ranges: the first digits of a card."""
    return {f"bin{n}": F.when(F.length(card) >= n, F.substring(card, 1, n)) for n in lengths}


def expiry_concentration(df: DataFrame, bin_: str, ts: str, expiry: str, card: str, empty: Sequence[str] = ("0", "", "00/00"), least: int = 3) -> DataFrame:
    """Distinct expiry dates of a BIN and day, and cards of the BIN, day and expiry date."""
    clean = df.withColumns({"__day": F.to_date(ts), "__expiry": F.when(~F.trim(expiry).isin(*empty), F.trim(expiry))})
    out = enrich(clean, [bin_, "__day"], {"expiries": F.countDistinct("__expiry")})
    cards = profile(clean, [bin_, "__day", "__expiry"], {"cards_same_expiry": F.countDistinct(card)})
    out = out.join(cards, [bin_, "__day", "__expiry"], "left").drop("__day", "__expiry")
    return out.withColumns({"expiries": F.coalesce("expiries", F.lit(0)), "cards_same_expiry": F.coalesce("cards_same_expiry", F.lit(0))}).withColumn("is_expiry_concentrated", _flag(F.col("cards_same_expiry") >= least))


def robotic_amount(df: DataFrame, bin_: str, ts: str, amount: str, card: str, least: int = 3, variation: float = 0.05) -> DataFrame:
    """Variation of the amounts of a BIN and day, distinct amounts, cards with the row's amount, and the robotic flag."""
    day = df.withColumn("__day", F.to_date(ts))
    out = enrich(day, [bin_, "__day"], {"cv": F.stddev_samp(amount) / F.nullif(F.avg(amount), F.lit(0.0)), "amounts": F.countDistinct(amount)})
    out = out.join(profile(day, [bin_, "__day", amount], {"cards_same_amount": F.countDistinct(card)}), [bin_, "__day", amount], "left").drop("__day")
    return out.withColumn("is_robotic", _flag((F.col("cards_same_amount") >= least) & (F.col("cv") < variation)))


def hour_profile(df: DataFrame, keys: Sequence[str], ts: str, sigmas: float = 2.0) -> DataFrame:
    """Usual hour of a merchant (deviation at least 1, 2 if unknown) and whether the row is outside it."""
    out = enrich(df.withColumn("__hour", F.hour(ts)), keys, {"hour_mean": F.avg("__hour"), "hour_std": F.stddev_samp("__hour")})
    out = out.withColumn("hour_std", F.greatest(F.coalesce("hour_std", F.lit(2.0)), F.lit(1.0)))
    return out.withColumn("is_odd_hour", _flag(F.abs(F.col("__hour") - F.col("hour_mean")) > sigmas * F.col("hour_std"))).drop("__hour")


def mean_of_counts(df: DataFrame, outer: Sequence[str], inner: Sequence[str], name: str = "mean_count") -> DataFrame:
    """Mean over the groups (outer + inner) of their row counts, for each outer group."""
    return profile(df, [*outer, *inner], {"__n": F.count(F.lit(1))}).groupBy(*outer).agg(F.avg("__n").alias(name))


def beyond_mean_count(df: DataFrame, count: str, outer: Sequence[str], inner: Sequence[str], times: float = 2.0, name: str = "mean_count") -> DataFrame:
    """Each row with the mean count of its outer group (to the cent) and whether its own ``count`` exceeds ``times`` that mean.

    A row with a null in ``outer`` has no mean and is held against 1; a null count is not beyond."""
    means = mean_of_counts(df, outer, inner, name).withColumn(name, F.round(name, 2))
    return df.join(means, list(outer), "left").withColumn(f"is_beyond_{name}", _flag(F.col(count) > times * F.coalesce(name, F.lit(1.0))))


def double_charge(df: DataFrame, keys: Sequence[str], amount: str, ts: str, row_id: str, days: float = 7.0) -> DataFrame:
    """Rows of the same keys and amount (to the cent) less than ``days`` after the one before; n_same and is_double.

    Rows with a null key or amount get nulls.
    """
    own = df.withColumn("__cents", F.bround(F.col(amount), 2))
    parts = key_parts([*keys, "__cents"], row_id)
    w = Window.partitionBy(*parts).orderBy(ts, row_id)
    gap = (F.unix_timestamp(F.col(ts).cast("timestamp")) - F.lag(F.unix_timestamp(F.col(ts).cast("timestamp"))).over(w)) / 86400
    same = known([*keys, "__cents"], F.count(F.lit(1)).over(Window.partitionBy(*parts)))
    out = own.withColumns({"n_same": same, "__gap": gap})
    return out.withColumn("is_double", known([*keys, "__cents"], _flag((F.col("n_same") >= 2) & (F.col("__gap") < days)))).drop("__cents", "__gap")


def frequency(df: DataFrame, keys: Sequence[str], recurring: Column, most: int = 3) -> DataFrame:
    """Rows of the keys, unusual where recurring and beyond ``most``."""
    out = enrich(df, keys, {"frequency": F.count(F.lit(1))})
    return out.withColumn("is_unusual_frequency", _flag(recurring.cast("boolean") & (F.col("frequency") > most)))


def recurring_gap_flags(df: DataFrame, gap_days: str, amount: str, is_first: str, early: float = 20, late: float = 45, share: float = 0.9) -> DataFrame:
    """Subscription flags from the gap to the previous charge: early, late, rapid (<120 min), zone of 15..120 minutes, new, first and large."""
    cut = F.broadcast(percentiles(df, amount, [share], "__p").select(F.col("__p")[0].alias("__cut")))  # one row
    gap, minutes = F.col(gap_days), F.col(gap_days) * 1440
    flags = {"is_early": _flag(gap < early), "is_late": _flag(gap > late), "is_rapid": _flag(minutes < 120), "is_zone": _flag(minutes.between(15, 120)), "is_new_subscription": _flag(F.col(is_first) == 1), "is_first_large": _flag((F.col(is_first) == 1) & (F.col(amount) >= F.col("__cut")))}
    return df.crossJoin(cut).withColumns(flags).drop("__cut")


def price_catalogue(df: DataFrame, amount: str, top: int = 8) -> DataFrame:
    """The most frequent amounts to the cent: price, n, place."""
    counts = df.filter(F.col(amount).isNotNull()).groupBy(F.bround(F.col(amount), 2).alias("price")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "price").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "price")))  # top rows only


def charge_types(df: DataFrame, amount: str, catalogue: DataFrame, recurring: Column, share: float = 0.01, multiple: float = 0.015, months: int = 12) -> DataFrame:
    """Charges against the price list (a few rows): base_price, second_price, n_months, a flag for each finding, and charge_type.

    A known price is within ``share`` of one of the list; several months are 2 to ``months`` base prices within ``multiple``; an
    add-on lies between 1.02 and 1.5 base prices and is neither; maintenance is within ``multiple`` of the second price; a
    recurring charge that is none of them is unexplained. The type is the first of known price, several months, add-on,
    maintenance, unexplained, other. Without a price list all recurring charges are unexplained; a null amount has null type.
    """
    prices = F.broadcast(catalogue.agg(F.sort_array(F.collect_list(F.struct("place", "price"))).alias("__prices")))
    out = df.crossJoin(prices).withColumn("__x", F.bround(F.col(amount), 2))
    x, base, second = F.col("__x"), F.col("base_price"), F.col("second_price")
    out = out.withColumns({"base_price": F.try_element_at("__prices", F.lit(1))["price"], "second_price": F.try_element_at("__prices", F.lit(2))["price"]})
    equal = F.filter(F.sequence(F.lit(2), F.lit(months)), lambda k: F.abs(x - base * k) <= multiple * (base * k))
    out = out.withColumns({"is_known_price": _flag(F.exists("__prices", lambda p: F.abs(x - p["price"]) <= share * (p["price"] + 0.01))), "__times": F.coalesce(F.array_max(equal), F.lit(1))})
    known_price, times = F.col("is_known_price") == 1, F.col("__times") > 1
    out = out.withColumns({
        "is_several_months": times.cast("int"), "n_months": F.when(known_price, 1).otherwise(F.col("__times")),
        "is_addon": _flag((x > base * 1.02) & (x < base * 1.5) & ~known_price & ~times), "is_maintenance": _flag(F.abs(x - second) <= multiple * (second + 0.01)),
    })
    named = (F.col("is_known_price") + F.col("is_several_months") + F.col("is_addon") + F.col("is_maintenance")) > 0
    out = out.withColumn("is_unexplained", _flag(recurring.cast("boolean") & x.isNotNull() & ~named))
    kinds = (("is_known_price", F.lit("known_price")), ("is_several_months", F.concat(F.lit("months_"), F.col("n_months"))), ("is_addon", F.lit("addon")), ("is_maintenance", F.lit("maintenance")), ("is_unexplained", F.lit("unexplained")))
    kind = F.lit("other")
    for flag, label in reversed(kinds):
        kind = F.when(F.col(flag) == 1, label).otherwise(kind)
    return out.withColumn("charge_type", F.when(x.isNotNull(), kind)).drop("__prices", "__x", "__times")

"""Exact percentiles of all rows and of groups, without all distinct values of anything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import with_range

#: Bins of a factor e that values are counted by before the exact pass.
BINS = 512


def value_counts(df: DataFrame, keys: Sequence[str], value: Column | str, *more: Column, x: str = "x", n: str = "n") -> DataFrame:
    """Keys, x (the value as a double), n and further aggregates for each distinct value of each group: added up before any
    shuffle, so a value that a third of all rows hold is one row. Nulls of the value have n 0."""
    own = F.col(value) if isinstance(value, str) else value
    return df.withColumn("__x", own.cast("double")).groupBy(*keys, F.col("__x").alias(x)).agg(F.count("__x").alias(n), *more)


def placed(counts: DataFrame, keys: Sequence[str], x: str = "x", n: str = "n") -> DataFrame:
    """Columns before (rows of the group with a smaller value) and total (of the group), for a table with one row for each group
    and value.

    The table is dealt into ranges of (keys, value): running totals over a group's ranges (a row for each), then inside each
    range. A group of any size is spread over ranges."""
    dealt = with_range(counts.select(*[c for c in counts.columns if c not in ("before", "total")]), [*keys, x])
    base = dealt.groupBy(*keys, "__range").agg(F.sum(n).alias("__m"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(keys)], F.col("__range").alias("__r"), F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__base"), F.sum("__m").over(group).alias("total"))
    same = F.col("__range") == F.col("__r")
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    within = Window.partitionBy(*keys, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("before", F.coalesce(F.sum(n).over(within), F.lit(0))).join(base, same)
    return out.withColumn("before", F.col("before") + F.col("__base")).drop("__range", "__r", "__base", *[f"__g{k}" for k in range(len(keys))])


def _bin(x: str) -> Column:
    """A number that never falls as the value rises: bins of equal width in logarithms, 0 in the middle, NaN last."""
    v = F.col(x).cast("double")
    return F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS))


def group_percentiles(counts: DataFrame, keys: Sequence[str], points: Sequence[float], name: str = "percentiles", x: str = "x", n: str = "n", stored: bool = False) -> DataFrame:
    """Keys and an array: each group's value at each point from 0 to 1, between two values in proportion.

    ``counts`` has a row for each group and value (several rows of one value do no harm). Groups without a value have no row;
    without keys there is always one row, of nulls where no value is. The counts are written once (``stored``: they are read
    from files already) and added up by bins; only the bins that hold a wanted place are put in order, so a group's values are
    neither sorted nor dealt over ranges as a whole."""
    own = counts.filter(F.col(x).isNotNull() & (F.col(n) > 0)).select(*keys, x, n)
    own = (own if stored else written(own, "values")).withColumn("__bin", _bin(x))
    group = Window.partitionBy(*keys)  # bins of a group: as many as BINS times the logarithms of its values at most
    earlier = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = own.groupBy(*keys, "__bin").agg(F.sum(n).alias("__m"))
    bins = bins.withColumns({"__first": F.coalesce(F.sum("__m").over(earlier), F.lit(0)), "__total": F.sum("__m").over(group)})
    places = [F.lit(float(p)) * (F.col("__total") - 1) for p in points]
    asked = F.lit(False)
    for at in places:
        asked = asked | ((F.floor(at) < F.col("__first") + F.col("__m")) & (F.ceil(at) >= F.col("__first")))
    # a few bins for each group: written, so that their size is known when they are joined
    asked = written(bins.filter(asked).select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(keys)], F.col("__bin").alias("__b"), "__first", "__total"), "asked")
    same = F.col("__bin") == F.col("__b")
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    held = own.join(asked, same).groupBy(*keys, "__bin", "__first", "__total", x).agg(F.sum(n).alias(n))
    own = placed(held, [*keys, "__bin"], x, n).withColumn("before", F.col("before") + F.col("__first"))
    pick = lambda at: F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col(n)), F.col(x)))
    found = own.groupBy(*keys).agg(F.max("__total").alias("__total"), *[pick(f(at)).alias(f"__{side}{k}") for k, at in enumerate(places) for side, f in (("a", F.floor), ("b", F.ceil))])
    values = []
    for k, at in enumerate(places):
        a, b = F.col(f"__a{k}"), F.col(f"__b{k}")
        values.append(F.when(F.floor(at) == F.ceil(at), a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b))
    return found.select(*keys, F.array(*values).alias(name))


def percentiles(df: DataFrame, value: Column | str, points: Sequence[float], name: str = "percentiles") -> DataFrame:
    """One row with an array: the value of all rows at each point. Nulls don't count; without any value the array holds nulls."""
    return group_percentiles(value_counts(df, [], value), [], points, name)

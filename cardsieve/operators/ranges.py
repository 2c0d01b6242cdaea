"""Ranges of an order that stay the same however often a plan is read, running numbers, and scans over keys of any size.

The bounds of the ranges are rows of the table themselves: of the rows with the smallest hash of all their columns, sorted by
the order, every so-many-th. That choice depends on the rows only, not on partitions or on which task ends first, so two
readings of one plan deal every row alike (``repartitionByRange`` samples anew for each reading and merges partitions as it
goes). Rows are dealt by comparing with the bounds, an array of fixed length in one broadcast row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Ranges at least (as many as the session's shuffle partitions if those are more), and sampled rows for each.
RANGES, SAMPLED = 64, 32
#: A key with a larger share of all rows, and at least so many, is dealt over ranges.
HOT_SHARE, HOT_ROWS = 1 / 16, 1 << 18


def range_count(df: DataFrame) -> int:
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def with_range(df: DataFrame, order: Sequence[str], ranges: int | None = None, name: str = "__range") -> DataFrame:
    """Column ``name``: the number of the row's range, from 0, rising with ``order`` (nulls first). Equal keys share a range."""
    ranges = ranges or range_count(df)
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)  # a null key alone is below every bound
    sample = df.select(key.alias("key"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.typeName() == "map"]).alias("chance")).orderBy("chance", "key").limit(ranges * SAMPLED)
    held = sample.agg(F.array_sort(F.collect_list("key")).alias("__held"))  # ranges * SAMPLED keys at most
    bound = lambda k: F.get("__held", F.floor(k * F.size("__held") / ranges).cast("int"))
    bounds = held.select(F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), bound))).alias("__bounds")) if ranges > 1 else held.select(F.slice("__held", 1, 0).alias("__bounds"))
    below = lambda array: F.size(F.filter(array, lambda b: b < key))
    # every step-th bound is compared first, then the bounds of one step: twice the square root of all
    step = max(1, round(ranges**0.5))
    bounds = bounds.withColumn("__coarse", F.filter("__bounds", lambda b, k: k % step == step - 1))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("__step0", below("__coarse") * step)  # one row
    return placed.withColumn(name, F.col("__step0") + below(F.slice(F.col("__bounds"), F.col("__step0") + 1, step))).drop("__bounds", "__coarse", "__step0")


def numbered(df: DataFrame, order: Sequence[str], start: int = 0, chunk: int | None = None, ranges: int | None = None) -> DataFrame:
    """Running number from start + 1 over all rows in ``order``, without gap or repeat, and the chunk of ``chunk`` rows it falls in.

    Rows equal in ``order`` are ordered, and dealt over ranges, by a hash of all columns. Numbers are the rows of earlier ranges
    plus the place within the range: no window over all rows."""
    own = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.typeName() == "map"]))
    dealt = with_range(own, [*order, "__tie"], ranges)
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__tie"))
    out = dealt.withColumn("__k", within).join(F.broadcast(base), "__range").withColumn("number", F.col("__k") + F.col("__base") + start)
    out = out.drop("__range", "__tie", "__k", "__base")
    return out.withColumn("chunk", F.ceil((F.col("number") - start) / chunk)) if chunk else out


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, rows: int = HOT_ROWS) -> list[tuple]:
    """The keys (without nulls) with more than ``share`` of all rows and at least ``rows``: 1 / share of them at most."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    counts = df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= rows)
    most = counts.orderBy(F.desc("__n")).limit(int(1 / share)).collect()
    least = share * df.count() if most else 0
    return [tuple(r)[:-1] for r in most if r["__n"] > least]


#: What a scan can carry from row to row: the aggregate of the rows before, and how a later part takes on an earlier one.
COUNT, SUM, LAST = "count", "sum", "last"


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, Column]], peers: bool = True, ranges: int | None = None, spread: bool = True) -> DataFrame:
    """For each row and column, over the rows of its key that come before it in ``order``: "count" (where the value is not null),
    "sum" (0 without any) or "last" (the latest that is not null) of a value.

    peers=False: rows equal in ``order`` don't come before one another. spread=True: a key's rows are dealt over ranges; each
    range is scanned by itself and takes on what the key's earlier ranges add up to, a row for each key and range. So no task
    holds a whole key. spread=False: a window for each key."""
    over = lambda w: {COUNT: lambda v: F.count(v).over(w), SUM: lambda v: F.coalesce(F.sum(v).over(w), F.lit(0)), LAST: lambda v: F.last(v, ignorenulls=True).over(w)}
    if not peers and len(order) > 1:
        raise ValueError("peers=False takes one numeric order column")
    frame = (lambda w: w.rowsBetween(Window.unboundedPreceding, -1)) if peers else (lambda w: w.rangeBetween(Window.unboundedPreceding, -1))
    if not spread:
        w = over(frame(Window.partitionBy(*keys).orderBy(*order)))
        return df.withColumns({name: w[kind](value) for name, (kind, value) in columns.items()})
    values = {f"__v{k}": value for k, (_, value) in enumerate(columns.values())}
    dealt = written(with_range(df.withColumns(values), [*keys, *order], ranges), "dealt")  # read for the parts' sums and for the rows
    kinds = [(f"__v{k}", f"__t{k}", name, kind) for k, (name, (kind, _)) in enumerate(columns.items())]
    latest = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order)))
    total = {COUNT: F.count, SUM: lambda v: F.coalesce(F.sum(v), F.lit(0)), LAST: latest}
    parts = dealt.groupBy(*keys, "__range").agg(*[total[kind](v).alias(t) for v, t, _, kind in kinds])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the key
    carry = {COUNT: lambda t: F.coalesce(F.sum(t).over(earlier), F.lit(0)), SUM: lambda t: F.coalesce(F.sum(t).over(earlier), F.lit(0)), LAST: lambda t: F.last(t, ignorenulls=True).over(earlier)}
    carried = parts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), *[carry[kind](t).alias(t) for _, t, _, kind in kinds])
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    w = over(frame(Window.partitionBy(*keys, "__range").orderBy(*order)))
    inside = dealt.withColumns({v: w[kind](F.col(v)) for v, _, _, kind in kinds})
    out = inside.join(carried, same, "left")
    joined = {name: F.coalesce(v, t) if kind == LAST else F.col(v) + F.coalesce(t, F.lit(0)) for v, t, name, kind in kinds}
    return out.withColumns(joined).drop("__range", "__r", *[f"__key{i}" for i in range(len(keys))], *[x for v, t, _, _ in kinds for x in (v, t)])

"""Features of a row from earlier rows of its key.

"Earlier" is by time, then by the row's unique id, so that rows of one instant have an order. Windows of time include the
row exactly ``seconds`` ago and leave the row itself out. Rows with a null key get nulls.

A key with more than ``HOT_SHARE`` of all rows (and ``HOT_ROWS``) is no window of its own: windows of time are put together from totals of time
buckets and the rows of the two buckets at their ends (``velocity``), and looks back without limit are scans over ranges that
hand on what came before (``ranges.scan``). Which keys are hot is counted first; the answer is the same either way. Pass
``spread`` (True or False) to decide without counting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import exact_mean, exact_parts
from .ranges import COUNT, HOT_ROWS, HOT_SHARE, LAST, SUM, hot_keys, scan

#: Windows of the preset, in seconds.
WINDOWS = {"2m": 120, "5m": 300, "10m": 600, "1h": 3600, "24h": 86400}


def _epoch(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _has(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def known(keys: Sequence[str], value: Column) -> Column:
    """The value where no key is null, else null."""
    return F.when(_has(keys), value)


def key_parts(keys: Sequence[str], row_id: str) -> list[str | Column]:
    """What a key's window is partitioned by: rows with a null key are spread by their ids, so they are no hot partition."""
    return [*keys, F.when(~_has(keys), F.xxhash64(row_id))]


def velocity(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, amount: str | None = None, windows: Mapping[str, int] = WINDOWS, prefix: str = "", hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, and sum of ``amount``, of the key's earlier rows in each window.

    A range frame up to the row's own second, less the rows of that second that don't come before it: all windows of a key
    share one sort. Keys with more than ``hot_share`` of all rows and at least ``hot_rows`` go through ``bucket_totals_velocity``.
    """
    hot = hot_keys(df, keys, hot_share, hot_rows)
    if not hot:
        return _key_windows(df, keys, ts, row_id, amount, windows, prefix)
    # a row for each hot key: at most 1 / hot_share
    table = df.sparkSession.createDataFrame(hot, df.select(*keys).schema).withColumnsRenamed({k: f"__hot_{k}" for k in keys}).withColumn("__hot", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__hot_{k}"))
    marked = df.join(F.broadcast(table), same, "left").drop(*[f"__hot_{k}" for k in keys])
    rest = _key_windows(marked.filter("__hot is null").drop("__hot"), keys, ts, row_id, amount, windows, prefix)
    return rest.unionByName(bucket_totals_velocity(marked.filter("__hot").drop("__hot"), keys, ts, row_id, amount, windows, prefix))


#: Buckets that a window is cut into, where its seconds can be divided so.
CUTS = (16, 15, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2)


def bucket_totals_velocity(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, amount: str | None = None, windows: Mapping[str, int] = WINDOWS, prefix: str = "") -> DataFrame:
    """``velocity`` for keys of any size (rows with a null key get nulls).

    A window of W seconds is cut into q buckets of W / q. A row at t in bucket i takes: the rows of its own bucket up to it; the
    totals of the whole buckets i - q + 1 to i - 1, sums of sums over a row for each key and bucket; and the rows of bucket
    i - q from t - W on, which it meets by asking there, as one more row at that second. Each part is a sum of what lies in the
    window, so nothing large is subtracted. The unit of work is a bucket of a key."""
    own = df.withColumn("__second", _epoch(ts)).withColumn("__amount", F.coalesce(F.col(amount).cast("double"), F.lit(0.0)) if amount else F.lit(0.0))
    out, added = own, []
    for name, seconds in windows.items():
        q = next((c for c in CUTS if seconds % c == 0), 1)
        width = seconds // q
        placed = out.withColumn("__bucket", F.floor(F.col("__second") / width))
        totals = placed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.sum("__amount").alias("__s"))
        # whole buckets between the two ends; a row also for the buckets of rows that have none before them
        whole = Window.partitionBy(*keys).orderBy("__bucket").rangeBetween(-(q - 1), -1)
        between = totals.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__bn"), F.coalesce(F.sum("__s").over(whole), F.lit(0.0)).alias("__bs")) if q > 1 else None
        inside = Window.partitionBy(*keys, "__bucket")
        own_bucket = inside.orderBy("__second", row_id).rowsBetween(Window.unboundedPreceding, -1)
        rows = placed.withColumns({"__on": F.count(F.lit(1)).over(own_bucket), "__os": F.coalesce(F.sum("__amount").over(own_bucket), F.lit(0.0))})
        # the edge: rows and questions of a bucket, by second; a question adds nothing itself
        data = placed.select(*keys, "__bucket", F.col("__second").alias("__at"), F.lit(None).cast(df.schema[row_id].dataType).alias("__ask"), F.lit(1).alias("__one"), F.col("__amount").alias("__x"))
        asks = placed.select(*keys, (F.col("__bucket") - q).alias("__bucket"), (F.col("__second") - seconds).alias("__at"), F.col(row_id).alias("__ask"), F.lit(0).alias("__one"), F.lit(0.0).alias("__x"))
        onward = inside.orderBy("__at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        edge = data.unionByName(asks).withColumns({"__en": F.sum("__one").over(onward), "__es": F.sum("__x").over(onward)}).filter("__one = 0").select("__ask", "__en", "__es")
        rows = rows.join(between, [*keys, "__bucket"], "left") if between is not None else rows.withColumns({"__bn": F.lit(0), "__bs": F.lit(0.0)})
        rows = rows.join(edge, rows[row_id] == edge["__ask"], "left")
        both = lambda *parts: sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
        columns = {f"{prefix}n_{name}": known(keys, both("__on", "__bn", "__en").cast("bigint"))}
        if amount:
            columns[f"{prefix}sum_{name}"] = known(keys, both("__os", "__bs", "__es"))
        added += list(columns)
        out = rows.withColumns(columns).select(*own.columns, *added)
    return out.drop("__second", "__amount")


def _key_windows(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, amount: str | None, windows: Mapping[str, int], prefix: str) -> DataFrame:
    second = "__second"
    out = df.withColumn(second, _epoch(ts))
    parts = key_parts(keys, row_id)
    tail = Window.partitionBy(*parts, second).orderBy(row_id).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    columns = {}
    for name, seconds in windows.items():
        frame = Window.partitionBy(*parts).orderBy(second).rangeBetween(-seconds, Window.currentRow)
        columns[f"{prefix}n_{name}"] = known(keys, F.count(F.lit(1)).over(frame) - F.count(F.lit(1)).over(tail))
        if amount:
            x = F.coalesce(F.col(amount), F.lit(0.0))
            columns[f"{prefix}sum_{name}"] = known(keys, F.sum(x).over(frame) - F.sum(x).over(tail))
    return out.withColumns(columns).drop(second)


def bucketed_velocity(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, seconds: int) -> DataFrame:
    """Column ``n_earlier``: the count of ``velocity`` for keys that hold a large share of all rows.

    Rows are dealt by key and time bucket of one window's length; each row also counts in the next bucket. So the rows of a
    window meet in one bucket, and a hot key is spread over its buckets.
    """
    own = df.withColumn("__second", _epoch(ts)).withColumn("__bucket", F.floor(F.col("__second") / seconds))
    both = own.select("*", F.explode(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(True).alias("home")), F.struct((F.col("__bucket") + 1).alias("b"), F.lit(False).alias("home")))).alias("__place"))
    both = both.select(*own.columns, F.col("__place.b").alias("__b"), F.col("__place.home").alias("__home"))
    frame = Window.partitionBy(*keys, "__b").orderBy("__second").rangeBetween(-seconds, Window.currentRow)
    tail = Window.partitionBy(*keys, "__b", "__second").orderBy(row_id).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = both.withColumn("n_earlier", known(keys, F.count(F.lit(1)).over(frame) - F.count(F.lit(1)).over(tail)))
    return out.filter("__home").drop("__second", "__bucket", "__b", "__home")


def _scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str, columns: Mapping[str, tuple[str, Column]], spread: bool | None, peers: bool = True) -> DataFrame:
    """``ranges.scan`` with rows of a null key each by itself, dealt over ranges where a key is hot."""
    spread = bool(hot_keys(df, keys)) if spread is None else spread
    alone = df.withColumn("__alone", F.when(~_has(keys), F.xxhash64(row_id)))
    return scan(alone, [*keys, "__alone"], order, columns, peers, spread=spread).drop("__alone")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sequence_features(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, prefix: str = "", spread: bool | None = None) -> DataFrame:
    """visit (number of the row), is_first, gap_minutes and gap_days to the previous row, days_since_last (whole days)."""
    out = _scanned(df, keys, [ts, row_id], row_id, {"__before": (COUNT, F.lit(1)), "__previous": (LAST, F.struct(_micros(ts).alias("t")))}, spread)
    seconds = (_micros(ts) - F.col("__previous.t")) / 1e6
    columns = {"visit": (F.col("__before") + 1).cast("int"), "is_first": (F.col("__before") == 0).cast("int")}
    columns |= {"gap_minutes": seconds / 60, "gap_days": seconds / 86400, "days_since_last": F.floor(seconds / 86400)}
    return out.withColumns({f"{prefix}{name}": known(keys, c) for name, c in columns.items()}).drop("__before", "__previous")


def transaction_order(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, minutes: float = 3.0, spread: bool | None = None) -> DataFrame:
    """Order number, lapse class (first, up to ``minutes``, beyond) and class of the key's count."""
    spread = bool(hot_keys(df, keys)) if spread is None else spread
    out = sequence_features(df, keys, ts, row_id, spread=spread)
    if spread:
        counts = df.filter(_has(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        out = out.join(counts, list(keys), "left")
    else:
        out = out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key_parts(keys, row_id))))
    n = F.col("__n")
    lapse = F.when(F.col("visit") == 1, "first").when(F.col("gap_minutes") <= minutes, "short").otherwise("long")
    return out.withColumns({"lapse_class": known(keys, lapse), "count_class": known(keys, F.when(n == 1, "single").when(n <= 3, "few").otherwise("many"))}).drop("__n")


def prior_count(df: DataFrame, flag: Column, keys: Sequence[str], ts: str, row_id: str, name: str = "prior_count", spread: bool | None = None) -> DataFrame:
    """How often the flag held on earlier rows of the key."""
    out = _scanned(df, keys, [ts, row_id], row_id, {name: (SUM, F.coalesce(flag.cast("int"), F.lit(0)))}, spread)
    return out.withColumn(name, known(keys, F.col(name)))


def prior_mean(df: DataFrame, amount: str, keys: Sequence[str], ts: str, row_id: str, times: float = 2.0, spread: bool | None = None) -> DataFrame:
    """prior_mean of the key's earlier rows, prior_ratio to it, and is_jump where the ratio is beyond ``times``."""
    units, rest = exact_parts(F.col(amount))
    out = _scanned(df, keys, [ts, row_id], row_id, {"__units": (SUM, units), "__rest": (SUM, rest), "__n": (COUNT, F.col(amount))}, spread)
    mean = exact_mean(F.col("__units"), F.col("__rest"), F.col("__n"))
    r = F.col(amount) / F.nullif(mean, F.lit(0.0))
    columns = {"prior_mean": mean, "prior_ratio": r, "is_jump": F.coalesce(r > times, F.lit(False)).cast("int")}
    return out.withColumns({n: known(keys, c) for n, c in columns.items()}).drop("__units", "__rest", "__n")


def previous_flag(df: DataFrame, flag: Column, keys: Sequence[str], ts: str, row_id: str, name: str = "previous_flag", spread: bool | None = None) -> DataFrame:
    out = _scanned(df, keys, [ts, row_id], row_id, {"__last": (LAST, F.struct(flag.cast("int").alias("f")))}, spread)
    return out.withColumn(name, known(keys, F.coalesce("__last.f", F.lit(0)))).drop("__last")


def flag_in_last(df: DataFrame, flag: Column, keys: Sequence[str], ts: str, row_id: str, seconds: int = 86400, name: str = "flag_in_last") -> DataFrame:
    """Whether the flag held on an earlier row of the key at most ``seconds`` ago."""
    counted = velocity(df.withColumn("__flag", F.coalesce(flag.cast("double"), F.lit(0.0))), keys, ts, row_id, "__flag", {"w": seconds}, "__")
    return counted.withColumn(name, known(keys, F.coalesce(F.col("__sum_w") > 0, F.lit(False)).cast("int"))).drop("__flag", "__n_w", "__sum_w")


def since_last(df: DataFrame, flag: Column, keys: Sequence[str], ts: str, unit: float = 60.0, name: str = "minutes_since_last", spread: bool | None = None) -> DataFrame:
    """Time since the key's latest flagged row that is strictly earlier: an as-of join as a scan. unit: 60 for minutes, 86400 for days."""
    own = df.withColumn("__micros", _micros(ts))
    flagged = F.when(F.coalesce(flag.cast("boolean"), F.lit(False)), F.col("__micros"))
    out = _scanned(own, keys, ["__micros"], ts, {"__latest": (LAST, flagged)}, spread, peers=False)
    return out.withColumn(name, known(keys, (F.col("__micros") - F.col("__latest")) / (unit * 1e6))).drop("__micros", "__latest")


def denied_before(df: DataFrame, denied: Column, keys: Sequence[str], ts: str, seconds: int = 86400, name: str = "denied_before") -> DataFrame:
    """Denied rows of the key in [t - seconds, t): a range join as a window over both streams."""
    w = Window.partitionBy(*key_parts(keys, ts)).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return df.withColumn(name, known(keys, F.coalesce(F.sum(F.coalesce(denied.cast("int"), F.lit(0))).over(w), F.lit(0))))


def distinct_in_last(df: DataFrame, column: str, keys: Sequence[str], ts: str, row_id: str, seconds: int = 86400, name: str = "distinct_in_last", spread: bool | None = None) -> DataFrame:
    """Distinct values of a column on the key's earlier rows at most ``seconds`` ago.

    That is the rows in the window less those whose previous row of the same value is in it too. So a row adds one from just
    after itself until it is too old, and takes one off again while its previous row is still in the window; a running sum of
    these steps, one row for each, gives the count at every row. No row holds a list of its window."""
    spread = bool(hot_keys(df, keys)) if spread is None else spread
    own = df.withColumn("__second", _epoch(ts))
    valued = own.filter(F.col(column).isNotNull() & _has(keys)).select(*keys, "__second", F.col(row_id).alias("__id"), F.col(column).alias("__value"))
    paired = scan(valued, [*keys, "__value"], ["__second", "__id"], {"__last": (LAST, F.col("__second"))}, spread=spread)
    repeat = F.coalesce(F.col("__last") + seconds >= F.col("__second"), F.lit(False))
    # (second, order at that second: 0 before its rows, 1 as a row, just after itself, step)
    step = lambda at, kind, n: F.struct(at.alias("__at"), F.lit(kind).alias("__kind"), n.cast("int").alias("__step"))
    steps = paired.select(*keys, "__id", F.inline(F.array(step(F.col("__second"), 1, F.when(repeat, 0).otherwise(1)), step(F.col("__second") + seconds + 1, 0, F.lit(-1)), step(F.col("__last") + seconds + 1, 0, F.when(repeat, 1).otherwise(0)))))
    steps = steps.filter("__at is not null and (__step <> 0)")
    rows = own.filter(_has(keys)).select(*keys, F.col(row_id).alias("__id"), F.col("__second").alias("__at"), F.lit(2).alias("__kind"), F.lit(0).alias("__step"))
    # kind 1 steps are after rows of smaller ids and before those of larger ones; a row asks just before its own step
    order = F.when(F.col("__kind") == 0, F.lit(0)).otherwise(1)
    every = steps.unionByName(rows).withColumns({"__turn": order, "__own": F.when(F.col("__kind") == 0, F.lit(None)).otherwise(F.col("__id")), "__then": F.when(F.col("__kind") == 2, 0).otherwise(1)})
    counted = scan(every, keys, ["__at", "__turn", "__own", "__then"], {name: (SUM, F.col("__step"))}, spread=spread).filter("__kind = 2").select(F.col("__id").alias("__asked"), F.col(name).cast("int").alias(name))
    return df.join(counted, df[row_id] == counted["__asked"], "left").drop("__asked")


def day_bucket_counts(df: DataFrame, key: str, ts: str, most: int = 6) -> DataFrame:
    """Rows of a key and day, clipped to ``most``: bucket, groups (key-days), keys."""
    daily = df.filter(F.col(key).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).count()
    bucket = F.when(F.col("count") >= most, f"{most}+").otherwise(F.col("count").cast("string"))
    return daily.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("groups"), F.countDistinct(key).alias("keys"))

"""Detection rules: each evaluation reads the rows once, however many rules there are."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def _stacked(out: DataFrame, names: Sequence[str], fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One wide row of sums <field>_<k> as a row for each name."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), *[F.col(f"{f}_{k}").alias(f) for f in fields]) for k, n in enumerate(names)])
    return out.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def effectiveness(df: DataFrame, flags: Sequence[str], fraud: Column) -> DataFrame:
    """Rows, frauds and others that each flag meets; precision, recall, ratio (frauds for each other row; 999 without others), lift."""
    own = df.select(*[_on(F.col(f)).cast("int").alias(f) for f in flags], _on(fraud).cast("int").alias("__f"))
    total = F.broadcast(own.agg(F.count(F.lit(1)).alias("rows"), F.sum("__f").alias("frauds")))  # one row
    long = own.unpivot(["__f"], list(flags), "rule", "on").filter("`on` = 1")
    out = long.groupBy("rule").agg(F.count(F.lit(1)).alias("impacted"), F.sum("__f").alias("captured"))
    out = out.crossJoin(total).withColumn("other", F.col("impacted") - F.col("captured"))
    precision = _share(F.col("captured"), F.col("impacted"))
    return out.select("rule", "impacted", "captured", "other", precision.alias("precision"), _share(F.col("captured"), F.col("frauds")).alias("recall"), F.when(F.col("other") == 0, 999.0).otherwise(F.col("captured") / F.nullif(F.col("other"), F.lit(0))).alias("ratio"), _share(precision, _share(F.col("frauds"), F.col("rows"))).alias("lift"))


def evaluate(df: DataFrame, rules: Mapping[str, Column], fraud: Column, client: str, amount: str) -> DataFrame:
    """Rows, clients and amounts of frauds and others that each rule meets; precision, recall, impact on the others."""
    f, columns = _on(fraud), []
    for k, rule in enumerate(rules.values()):
        hit = _on(rule)
        columns += [F.count(F.when(hit & f, 1)).alias(f"captured_{k}"), F.count(F.when(hit & ~f, 1)).alias(f"other_{k}"), F.countDistinct(F.when(hit & f, F.col(client))).alias(f"clients_{k}"), F.coalesce(F.sum(F.when(hit & f, F.col(amount))), F.lit(0.0)).alias(f"fraud_amount_{k}"), F.coalesce(F.sum(F.when(hit & ~f, F.col(amount))), F.lit(0.0)).alias(f"other_amount_{k}")]
    wide = df.agg(*columns, F.count(F.when(f, 1)).alias("frauds"), F.count(F.when(~f, 1)).alias("others"))
    out = _stacked(wide, list(rules), ("captured", "other", "clients", "fraud_amount", "other_amount"), ("frauds", "others"))
    out = out.withColumns({"precision": _share(F.col("captured"), F.col("captured") + F.col("other")), "recall": _share(F.col("captured"), F.col("frauds")), "impact": _share(F.col("other"), F.col("others"))})
    return out.drop("frauds", "others")


def _pair_counts(df: DataFrame, conditions: Sequence[Column], fraud: Column, amount: Column, wanted: Sequence[tuple[int, int]]) -> DataFrame:
    """i, j, impacted, captured, fraud_amount for each wanted pair of conditions that meet: rows where both hold.

    A task packs each condition's rows into a bitmap, batch by batch, and counts the bits of two bitmaps' AND; it sends one row
    for each pair at its end. So the work of a row doesn't grow with the number of its active conditions squared."""
    own = df.select(F.array(*[_on(c) for c in conditions]).alias("on"), _on(fraud).alias("f"), F.coalesce(amount.cast("double"), F.lit(0.0)).alias("x"))
    width, first, second = len(conditions), *(np.array(side, np.int64) for side in zip(*wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, captured, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first))
        for batch in batches:
            if not batch.num_rows:
                continue
            on = batch.column("on").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            f, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("f", "x"))
            bits = np.packbits(on, axis=0).T  # conditions x bytes
            frauds = bits & np.packbits(f)
            hit = on[f]
            sums = (hit * x[f][:, None]).T @ hit
            for k, (i, j) in enumerate(zip(first, second)):
                n[k] += int(np.bitwise_count(bits[i] & bits[j]).sum())
                captured[k] += int(np.bitwise_count(frauds[i] & bits[j]).sum())
            total += sums[first, second]
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(first[met]), pa.array(second[met]), pa.array(n[met]), pa.array(captured[met]), pa.array(total[met])], ["i", "j", "n", "f", "x"])

    counted = own.mapInArrow(count, "i bigint, j bigint, n bigint, f bigint, x double")
    return counted.groupBy("i", "j").agg(F.sum("n").alias("impacted"), F.sum("f").alias("captured"), F.sum("x").alias("fraud_amount"))


def rule_pairs(df: DataFrame, rules: Mapping[str, Column], fraud: Column, least: int = 2, strong: float = 1.0, fair: float = 0.2) -> DataFrame:
    """All pairs of rules, however many: rows where both hold, by fraud; ratio, action class."""
    names = sorted(rules)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    out = _pair_counts(df, [rules[n] for n in names], fraud, F.lit(0.0), pairs).filter(F.col("captured") >= least)
    listed = F.array(*map(F.lit, names))
    out = out.select(F.get(listed, F.col("i").cast("int")).alias("first"), F.get(listed, F.col("j").cast("int")).alias("second"), "impacted", "captured")
    other = F.col("impacted") - F.col("captured")
    r = F.when(other == 0, 999.0).otherwise(F.col("captured") / F.nullif(other, F.lit(0)))
    return out.withColumns({"other": other, "ratio": r, "action": F.when(r >= strong, "block").when(r >= fair, "challenge").otherwise("watch")})


def combinations(df: DataFrame, rules: Mapping[str, Column], fraud: Column, amount: str, segments: Mapping[str, Column] = {}, score: str | None = None, cuts: Sequence[float] = (2, 3, 4, 5, 6), profile: str | None = None, levels: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Combined rules with at least ``least`` frauds: each two rules, each segment with each rule, score >= cut, and profile at a
    level or beyond (``levels`` rise). One reading of the rows for all.

    rule, kind, impacted, captured, captured_pct (of all frauds), fraud_amount, other, other_pct (of all others), precision,
    ratio (captured_pct by other_pct; 999 without others), lift and action; percentages and what comes of them have two digits, halves up."""
    names, conditions, wanted, named = list(rules), list(rules.values()), [], []
    wanted += [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    named += [("pair", f"{names[i]} AND {names[j]}") for i, j in wanted]
    for s, c in segments.items():
        named += [("segment", f"{s} AND {n}") for n in names]
        wanted += [(len(conditions), i) for i in range(len(names))]
        conditions.append(c)
    alone = [("score", f"{score} >= {c:g}", F.col(score) >= c) for c in cuts] if score else []
    alone += [("profile", f"{profile} >= {v}", F.col(profile).isin(*levels[k:])) for k, v in enumerate(levels)] if profile else []
    for kind, rule, c in alone:
        named.append((kind, rule))
        wanted.append((len(conditions), len(conditions)))
        conditions.append(c)
    counted = _pair_counts(df, conditions, fraud, F.col(amount), wanted).filter(F.col("captured") >= least)
    listed = F.broadcast(df.sparkSession.createDataFrame([(i, j, *x) for (i, j), x in zip(wanted, named)], "i bigint, j bigint, kind string, rule string"))  # a row for each rule
    totals = F.broadcast(df.agg(F.count(F.when(_on(fraud), 1)).alias("__f"), F.count(F.lit(1)).alias("__n")))  # one row
    out = counted.join(listed, ["i", "j"]).crossJoin(totals).withColumn("other", F.col("impacted") - F.col("captured"))
    # hundredths as whole numbers, halves up: no rounding of doubles, the same in every engine
    out = out.withColumns({name: F.expr(f"coalesce((20000 * {a} + {b}) div nullif(2 * {b}, 0), 0)") for name, a, b in (("__c", "captured", "__f"), ("__o", "other", "(__n - __f)"), ("__p", "captured", "impacted"))})
    out = out.withColumns({"captured_pct": F.col("__c") / 100, "other_pct": F.col("__o") / 100, "precision": F.col("__p") / 100, "fraud_amount": F.round("fraud_amount", 2)})
    out = out.withColumns({"ratio": F.coalesce(F.expr("(200 * __c + __o) div nullif(2 * __o, 0)") / 100, F.lit(999.0)), "lift": F.expr("(2 * __p * __n + 100 * __f) div nullif(200 * __f, 0)") / 100})
    action = F.when((F.col("precision") >= 40) & (F.col("ratio") >= 5), "block").when((F.col("precision") >= 20) & (F.col("ratio") >= 3), "review").otherwise("alert")
    return out.select("rule", "kind", "impacted", "captured", "captured_pct", "fraud_amount", "other", "other_pct", "precision", "ratio", "lift", action.alias("action")).orderBy(F.desc("ratio"), F.desc("captured_pct"), "rule")


def cascade(df: DataFrame, rules: Mapping[str, Column], fraud: Column) -> DataFrame:
    """Rules in order: rows that each is the first to meet, and cumulative recall and precision."""
    first = F.coalesce(*[F.when(_on(r), F.lit(k + 1)) for k, r in enumerate(rules.values())])
    own = df.select(first.alias("step"), _on(fraud).cast("int").alias("f"))
    out = own.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("captured"))
    total = F.broadcast(out.agg(F.sum("captured").alias("frauds")))
    named = df.sparkSession.createDataFrame([(k + 1, n) for k, n in enumerate(rules)], "step int, rule string")
    out = F.broadcast(named).join(out, "step", "left").na.fill(0, ["n", "captured"]).crossJoin(total)
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row for each rule
    return out.select("step", "rule", "n", "captured", F.sum("captured").over(w).alias("captured_so_far"), _share(F.sum("captured").over(w), F.col("frauds")).alias("recall_so_far"), _share(F.sum("captured").over(w), F.sum("n").over(w)).alias("precision_so_far"))


def segment_matrix(df: DataFrame, dims: Sequence[str], signals: Mapping[str, Column], fraud: Column, least_rate: float = 0.25, least_frauds: int = 5) -> DataFrame:
    """For each value of each dimension and each signal: base rate, rate with the signal, lift, candidate flag."""
    own = df.select(*[F.col(d).cast("string").alias(d) for d in dims], *[_on(c).cast("int").alias(f"s_{n}") for n, c in signals.items()], _on(fraud).cast("int").alias("f"))
    long = own.unpivot(["f", *[f"s_{n}" for n in signals]], list(dims), "dimension", "value")
    sums = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("frauds"), *[F.sum(f"s_{n}").alias(f"hit_{k}") for k, n in enumerate(signals)], *[F.sum(F.col(f"s_{n}") * F.col("f")).alias(f"caught_{k}") for k, n in enumerate(signals)])
    out = _stacked(sums, list(signals), ("hit", "caught"), ("dimension", "value", "n", "frauds")).withColumnRenamed("rule", "signal")
    base, rate = _share(F.col("frauds"), F.col("n")), _share(F.col("caught"), F.col("hit"))
    return out.withColumns({"base_rate": base, "signal_rate": rate, "lift": _share(rate, base), "is_candidate": F.coalesce((rate >= least_rate) & (F.col("caught") >= least_frauds), F.lit(False)).cast("int")})


def threshold_scan(df: DataFrame, score: str, cuts: Sequence[float], fraud: Column) -> DataFrame:
    """Capture, false alarms and precision at each cut, and the usual metrics of a classifier there.

    Each row is counted once, at the highest cut it reaches; sums from the top give the rest.
    """
    cuts = sorted(set(map(float, cuts)))
    reached = F.lit(None).cast("int")
    for k, c in enumerate(cuts):
        reached = F.when(F.col(score) >= c, F.lit(k)).otherwise(reached)
    own = df.select(F.coalesce(reached, F.lit(-1)).alias("k"), _on(fraud).cast("int").alias("f"))
    counts = own.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"))
    every = F.broadcast(df.sparkSession.createDataFrame([(-1, None), *enumerate(cuts)], "k int, cut double")).join(counts, "k", "left").na.fill(0, ["n", "f"])
    w, whole = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each cut
    t = every.select("k", "cut", F.sum("n").over(w).alias("flagged"), F.sum("f").over(w).alias("captured"), F.sum("n").over(whole).alias("n"), F.sum("f").over(whole).alias("frauds")).filter("k >= 0")
    fp, tp = F.col("flagged") - F.col("captured"), F.col("captured")
    precision, recall = _share(tp, F.col("flagged")), _share(tp, F.col("frauds"))
    return t.select("cut", "flagged", "captured", fp.alias("false_alarms"), precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"), (1 - _share(fp, F.col("n") - F.col("frauds"))).alias("specificity"), _share(F.col("flagged"), F.col("n")).alias("share_flagged"))


def segmented_rules(df: DataFrame, amounts: Sequence[float], segments: Mapping[str, Column], amount: str, fraud: Column, client: str) -> DataFrame:
    """Rules amount >= t, alone and within each segment."""
    rules = {}
    for t in amounts:
        over = F.col(amount) >= t
        rules[f"amount>={t:g}"] = over
        rules |= {f"amount>={t:g} & {n}": over & _on(c) for n, c in segments.items()}
    return evaluate(df, rules, fraud, client, amount)


def simulate(df: DataFrame, filters: Sequence[Column], rule: Column, fraud: Column, client: str, amount: str, good: float = 0.2, poor: float = 0.05) -> DataFrame:
    """Effect of one rule on the filtered rows, with a verdict by precision."""
    own = df.filter(reduce(lambda a, b: a & b, filters)) if filters else df
    out = evaluate(own, {"rule": rule}, fraud, client, amount)
    return out.withColumn("verdict", F.when(F.col("precision") >= good, "good").when(F.col("precision") >= poor, "fair").otherwise("poor"))


def compare_detectors(df: DataFrame, detectors: Mapping[str, Column], fraud: Column) -> DataFrame:
    """Rows, recall and precision of each detector and of all together."""
    every = dict(detectors) | {"consensus": reduce(lambda a, b: a & b, [_on(c) for c in detectors.values()])}
    own = df.select(*[_on(c).cast("int").alias(f"d{k}") for k, c in enumerate(every.values())], _on(fraud).cast("int").alias("f"))
    wide = own.agg(F.sum("f").alias("frauds"), *[F.sum(f"d{k}").alias(f"n_{k}") for k in range(len(every))], *[F.sum(F.col(f"d{k}") * F.col("f")).alias(f"captured_{k}") for k in range(len(every))])
    out = _stacked(wide, list(every), ("n", "captured"), ("frauds",)).withColumnRenamed("rule", "detector")
    return out.select("detector", "n", "captured", _share(F.col("captured"), F.col("frauds")).alias("recall"), _share(F.col("captured"), F.col("n")).alias("precision"))


def review_list(df: DataFrame, normal: Column, score: str, row_id: str, top: int = 50) -> DataFrame:
    """The normal rows with the highest suspicion."""
    return df.filter(_on(normal)).orderBy(F.desc(score), row_id).limit(top)

"""Queries that evaluate rules, scores and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, stats
from .registry import T, purchases, query, rounded

_FLAGS = T + """, f AS (SELECT *, qty >= 40 AS a, discount >= 0.08 AS b, amount >= 60000 AS c FROM t)"""


def _flagged(spark, sf_dir):
    return purchases(spark, sf_dir).withColumns({"a": F.col("qty") >= 40, "b": F.col("discount") >= 0.08, "c": F.col("amount") >= 60000})


def _rules():
    return {"a": F.col("qty") >= 40, "b": F.col("discount") >= 0.08, "c": F.col("amount") >= 60000}


@query(_FLAGS + """, l AS (SELECT 'a' AS rule, fraud FROM f WHERE a UNION ALL SELECT 'b', fraud FROM f WHERE b UNION ALL SELECT 'c', fraud FROM f WHERE c), g AS (SELECT count(*) AS n, sum(CAST(fraud AS INT)) AS fr FROM f)
    SELECT rule, count(*) AS impacted, sum(CAST(fraud AS INT)) AS captured, count(*) FILTER (NOT fraud) AS other, round(avg(CAST(fraud AS INT)), 6) AS precision, round(sum(CAST(fraud AS INT)) / any_value(fr), 6) AS recall,
    round(sum(CAST(fraud AS INT)) / count(*) FILTER (NOT fraud), 6) AS ratio, round(avg(CAST(fraud AS INT)) / any_value(fr / n), 6) AS lift FROM l, g GROUP BY rule""")
def flag_effectiveness(spark, sf_dir):
    out = rules.effectiveness(_flagged(spark, sf_dir), ["a", "b", "c"], F.col("fraud"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "ratio", "lift")})


@query(_FLAGS + """, l AS (SELECT 'a' AS rule, * FROM f WHERE a UNION ALL SELECT 'b', * FROM f WHERE b UNION ALL SELECT 'c', * FROM f WHERE c), g AS (SELECT count(*) FILTER (fraud) AS fr, count(*) FILTER (NOT fraud) AS ot FROM f)
    SELECT rule, count(*) FILTER (fraud) AS captured, count(*) FILTER (NOT fraud) AS other, count(DISTINCT client) FILTER (fraud) AS clients, round(sum(amount) FILTER (fraud), 2) AS fraud_amount, round(count(*) FILTER (fraud) / any_value(fr), 6) AS recall, round(count(*) FILTER (NOT fraud) / any_value(ot), 6) AS impact FROM l, g GROUP BY rule""")
def rule_evaluation(spark, sf_dir):
    out = rules.evaluate(purchases(spark, sf_dir), _rules(), F.col("fraud"), "client", "amount")
    return out.select("rule", "captured", "other", "clients", F.round("fraud_amount", 2).alias("fraud_amount"), F.round("recall", 6).alias("recall"), F.round("impact", 6).alias("impact"))


@query(_FLAGS + """, p AS (SELECT 'a' AS first, 'b' AS second, fraud FROM f WHERE a AND b UNION ALL SELECT 'a', 'c', fraud FROM f WHERE a AND c UNION ALL SELECT 'b', 'c', fraud FROM f WHERE b AND c)
    SELECT first, second, count(*) AS impacted, sum(CAST(fraud AS INT)) AS captured, count(*) FILTER (NOT fraud) AS other, round(sum(CAST(fraud AS INT)) / count(*) FILTER (NOT fraud), 6) AS ratio FROM p GROUP BY ALL""")
def rule_pairs(spark, sf_dir):
    out = rules.rule_pairs(purchases(spark, sf_dir), _rules(), F.col("fraud"))
    return out.select("first", "second", "impacted", "captured", "other", F.round("ratio", 6).alias("ratio"))


def _many():
    """Columns need a session, so they are made when a query runs."""
    return {f"q{q}": F.col("qty") >= q for q in range(30, 50, 2)} | {f"d{d}": F.col("discount") >= d / 100 for d in range(3, 10)} | {f"m{m}": F.col("mcc") == m for m in range(5)}


_MANY_SQL = "UNION ALL ".join([f"SELECT 'q{q}' AS rule, id FROM f WHERE qty >= {q} " for q in range(30, 50, 2)] + [f"SELECT 'd{d}', id FROM f WHERE discount >= {d / 100} " for d in range(3, 10)] + [f"SELECT 'm{m}', id FROM f WHERE mcc = {m} " for m in range(5)])
_ORDER = [f"q{q}" for q in range(30, 50, 2)] + [f"d{d}" for d in range(3, 10)] + [f"m{m}" for m in range(5)]


@query(T + f""", f AS (SELECT row_number() OVER () AS id, CAST(qty >= 40 AS INT) + CAST(discount >= 0.08 AS INT) + CAST(amount >= 60000 AS INT) AS score, * FROM t), l AS ({_MANY_SQL}),
    o AS (SELECT unnest({_ORDER!r}) AS rule, generate_subscripts({_ORDER!r}, 1) AS k),
    r AS (SELECT l.*, k FROM l JOIN o USING (rule)),
    m AS (SELECT x.rule || ' AND ' || y.rule AS rule, 'pair' AS kind, x.id FROM r x JOIN r y ON x.id = y.id AND x.k < y.k
          UNION ALL SELECT 'approved AND ' || rule, 'segment', id FROM r JOIN f USING (id) WHERE approved UNION ALL SELECT 'late AND ' || rule, 'segment', id FROM r JOIN f USING (id) WHERE NOT approved
          UNION ALL SELECT 'score >= ' || c, 'score', id FROM f, unnest([1, 2, 3]) AS t(c) WHERE score >= c
          UNION ALL SELECT 'level >= mid', 'profile', id FROM f WHERE score >= 2 UNION ALL SELECT 'level >= high', 'profile', id FROM f WHERE score >= 3),
    g AS (SELECT count(*) AS n, count(*) FILTER (fraud) AS fr FROM f),
    c AS (SELECT rule, kind, count(*) AS impacted, count(*) FILTER (fraud) AS captured, round(coalesce(sum(amount) FILTER (fraud), 0), 2) AS fraud_amount, count(*) FILTER (NOT fraud) AS other FROM m JOIN f USING (id) GROUP BY rule, kind HAVING count(*) FILTER (fraud) >= 2),
    p AS (SELECT c.*, n, fr, (20000 * captured + fr) // (2 * fr) AS cp, (20000 * other + (n - fr)) // (2 * (n - fr)) AS op, (20000 * captured + impacted) // (2 * impacted) AS pp FROM c, g),
    q AS (SELECT *, cp / 100 AS captured_pct, op / 100 AS other_pct, pp / 100 AS precision, CASE WHEN op > 0 THEN ((200 * cp + op) // (2 * op)) / 100 ELSE 999 END AS ratio, ((2 * pp * n + 100 * fr) // (200 * fr)) / 100 AS lift FROM p)
    SELECT rule, kind, impacted, captured, captured_pct, fraud_amount, other, other_pct, precision, ratio, lift, CASE WHEN precision >= 40 AND ratio >= 5 THEN 'block' WHEN precision >= 20 AND ratio >= 3 THEN 'review' ELSE 'alert' END AS action FROM q""")
def rule_combinations(spark, sf_dir):
    own = _flagged(spark, sf_dir)
    score = sum((F.col(c).cast("int") for c in "abc"), F.lit(0))
    own = own.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 3, "high").when(F.col("score") == 2, "mid").otherwise("low"))
    return rules.combinations(own, _many(), F.col("fraud"), "amount", {"approved": F.col("approved"), "late": ~F.col("approved")}, "score", (1, 2, 3), "level", ("mid", "high"))


@query(_FLAGS + """, s AS (SELECT CASE WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 END AS step, count(*) AS n, sum(CAST(fraud AS INT)) AS captured FROM f GROUP BY 1), g AS (SELECT sum(captured) AS fr FROM s)
    SELECT step, n, captured, sum(captured) OVER (ORDER BY step) AS captured_so_far, round(sum(captured) OVER (ORDER BY step) / fr, 6) AS recall_so_far, round(sum(captured) OVER (ORDER BY step) / sum(n) OVER (ORDER BY step), 6) AS precision_so_far FROM s, g WHERE step IS NOT NULL""")
def rule_cascade(spark, sf_dir):
    out = rules.cascade(purchases(spark, sf_dir), _rules(), F.col("fraud"))
    return out.select("step", "n", "captured", "captured_so_far", F.round("recall_so_far", 6).alias("recall_so_far"), F.round("precision_so_far", 6).alias("precision_so_far"))


@query(_FLAGS + """, l AS (SELECT 'reason' AS dimension, reason AS value, * FROM f UNION ALL SELECT 'mcc', CAST(mcc AS VARCHAR), * FROM f), s AS (SELECT dimension, value, 'a' AS signal, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds, count(*) FILTER (a) AS hit, count(*) FILTER (a AND fraud) AS caught FROM l GROUP BY ALL UNION ALL
    SELECT dimension, value, 'b', count(*), sum(CAST(fraud AS INT)), count(*) FILTER (b), count(*) FILTER (b AND fraud) FROM l GROUP BY ALL)
    SELECT dimension, value, signal, n, frauds, hit, caught, round(caught / nullif(hit, 0), 6) AS signal_rate, round((caught / nullif(hit, 0)) / nullif(frauds / n, 0), 6) AS lift, CAST(coalesce(caught / nullif(hit, 0) >= 0.25 AND caught >= 5, false) AS INT) AS is_candidate FROM s""")
def segment_matrix(spark, sf_dir):
    signals = {k: v for k, v in _rules().items() if k != "c"}
    out = rules.segment_matrix(purchases(spark, sf_dir), ["reason", "mcc"], signals, F.col("fraud"))
    return out.select("dimension", "value", "signal", "n", "frauds", "hit", "caught", F.round("signal_rate", 6).alias("signal_rate"), F.round("lift", 6).alias("lift"), "is_candidate")


@query(T + """, c AS (SELECT unnest([10.0, 20.0, 30.0, 40.0]) AS cut), x AS (SELECT cut, count(*) FILTER (qty >= cut) AS flagged, count(*) FILTER (qty >= cut AND fraud) AS captured, count(*) AS n, count(*) FILTER (fraud) AS fr FROM t, c GROUP BY cut)
    SELECT CAST(cut AS DOUBLE) AS cut, flagged, captured, flagged - captured AS false_alarms, round(captured / flagged, 6) AS precision, round(captured / fr, 6) AS recall, round(1 - (flagged - captured) / (n - fr), 6) AS specificity, round(flagged / n, 6) AS share_flagged FROM x""")
def threshold_scan(spark, sf_dir):
    out = rules.threshold_scan(purchases(spark, sf_dir), "qty", [10, 20, 30, 40], F.col("fraud"))
    return out.select("cut", "flagged", "captured", "false_alarms", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "share_flagged")])


@query(T + """, x AS (SELECT 'amount>=30000' AS rule, fraud FROM t WHERE amount >= 30000 UNION ALL SELECT 'amount>=30000 & big', fraud FROM t WHERE amount >= 30000 AND qty > 25) SELECT rule, count(*) FILTER (fraud) AS captured, count(*) FILTER (NOT fraud) AS other FROM x GROUP BY rule""")
def segmented_rules(spark, sf_dir):
    out = rules.segmented_rules(purchases(spark, sf_dir), [30000], {"big": F.col("qty") > 25}, "amount", F.col("fraud"), "client")
    return out.select("rule", "captured", "other")


@query(T + "SELECT count(*) FILTER (qty >= 40 AND fraud) AS captured, count(*) FILTER (qty >= 40 AND NOT fraud) AS other, 'good' AS verdict FROM t WHERE reason = '5-LOW' AND ts >= TIMESTAMP '1997-01-01'")
def simulated_rule(spark, sf_dir):
    out = rules.simulate(purchases(spark, sf_dir), [F.col("reason") == "5-LOW", F.col("ts") >= F.lit("1997-01-01").cast("timestamp_ntz")], F.col("qty") >= 40, F.col("fraud"), "client", "amount")
    return out.select("captured", "other", "verdict")


@query(_FLAGS + """, l AS (SELECT 'a' AS detector, fraud FROM f WHERE a UNION ALL SELECT 'b', fraud FROM f WHERE b UNION ALL SELECT 'consensus', fraud FROM f WHERE a AND b), g AS (SELECT sum(CAST(fraud AS INT)) AS fr FROM f)
    SELECT detector, count(*) AS n, sum(CAST(fraud AS INT)) AS captured, round(sum(CAST(fraud AS INT)) / any_value(fr), 6) AS recall, round(avg(CAST(fraud AS INT)), 6) AS precision FROM l, g GROUP BY detector""")
def detector_comparison(spark, sf_dir):
    out = rules.compare_detectors(purchases(spark, sf_dir), {k: v for k, v in _rules().items() if k != "c"}, F.col("fraud"))
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


@query(_FLAGS + "SELECT indicator, count(*) AS n, sum(CAST(a AS INT)) AS first, sum(CAST(b AS INT)) AS second, sum(CAST(a AND b AS INT)) AS consensus FROM f GROUP BY indicator")
def anomaly_overlap(spark, sf_dir):
    r = _rules()
    return stats.anomaly_overlap(purchases(spark, sf_dir), r["a"], r["b"], "indicator")


@query(T + """, x AS (SELECT qty, fraud FROM t), v AS (SELECT qty AS x, sum(CAST(fraud AS INT)) AS a, count(*) AS t FROM x GROUP BY qty), k AS (SELECT *, coalesce(sum(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM v),
    s AS (SELECT sum(a * rank) AS r, CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(t) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) ** 3 - t) AS ties FROM k)
    SELECT 'qty' AS variable, r - n1 * (n1 + 1) / 2 AS u, round((r - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z, (SELECT median(qty) FROM x WHERE fraud) AS median_group FROM s""")
def rank_test(spark, sf_dir):
    out = stats.mann_whitney(purchases(spark, sf_dir), ["qty"], F.col("fraud"))
    return out.select("variable", "u", F.round("z", 6).alias("z"), "median_group")


@query(T + "SELECT 'amount' AS variable, round(corr(amount, CAST(fraud AS INT)), 6) AS r FROM t UNION ALL SELECT 'qty', round(corr(qty, CAST(fraud AS INT)), 6) FROM t")
def correlations(spark, sf_dir):
    return stats.correlations(purchases(spark, sf_dir), ["amount", "qty"], F.col("fraud").cast("int")).select("variable", F.round("r", 6).alias("r"))


@query(T + "SELECT 'amount' AS a, 'qty' AS b, round(corr(amount, qty), 6) AS r FROM t UNION ALL SELECT 'amount', 'discount', round(corr(amount, discount), 6) FROM t UNION ALL SELECT 'qty', 'discount', round(corr(qty, discount), 6) FROM t")
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(purchases(spark, sf_dir), ["amount", "qty", "discount"]).withColumn("r", F.round("r", 6))


@query(T + """, a AS (SELECT amount AS x, ts < TIMESTAMP '1999-01-01' AS train FROM t), e AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM a WHERE train),
    b AS (SELECT train, len(list_filter(edges, lambda v: v < x)) AS bin FROM a, e), c AS (SELECT bin, count(*) FILTER (train) AS p, count(*) FILTER (NOT train) AS q FROM b GROUP BY bin), f AS (SELECT greatest(p / sum(p) OVER (), 0.0001) AS p, greatest(q / sum(q) OVER (), 0.0001) AS q FROM c)
    SELECT 'amount' AS variable, round(sum((q - p) * ln(q / p)), 6) AS psi, CASE WHEN sum((q - p) * ln(q / p)) < 0.1 THEN 'stable' ELSE 'shifted' END AS class FROM f""")
def population_stability(spark, sf_dir):
    own, cut = purchases(spark, sf_dir), F.lit("1999-01-01").cast("timestamp_ntz")
    return stats.psi(own.filter(F.col("ts") < cut), own.filter(F.col("ts") >= cut), ["amount"]).withColumn("psi", F.round("psi", 6))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS s, CAST(o_orderstatus = 'F' AS INT) AS f, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders), d AS (SELECT CAST(floor((rank - 1) * 10 / n) AS BIGINT) + 1 AS decile, count(*) AS n, sum(f) AS frauds FROM x GROUP BY 1)
    SELECT decile, n, frauds, round(frauds / n, 6) AS rate, round(sum(frauds) OVER (ORDER BY decile) / sum(frauds) OVER (), 6) AS capture FROM d""")
def score_deciles(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = stats.decile_lift(o, "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F")
    return out.select("decile", "n", "frauds", F.round("rate", 6).alias("rate"), F.round("capture", 6).alias("capture"))


_SCORE = T + """, x AS (SELECT qty / 50.0 AS s, CAST(fraud AS INT) AS f FROM t), v AS (SELECT s, count(*) AS n, sum(f) AS f FROM x GROUP BY s), tot AS (SELECT sum(f) AS p, sum(n) - sum(f) AS q FROM v),
    c AS (SELECT s, n, v.f, sum(v.f) OVER (ORDER BY s DESC) / p AS tpr, (sum(n) OVER (ORDER BY s DESC) - sum(v.f) OVER (ORDER BY s DESC)) / q AS fpr, p, q FROM v, tot)"""


@query(_SCORE + """SELECT round(sum((tpr - f / p / 2) * (n - f) / q), 6) AS auc, round(max(tpr - fpr), 6) AS ks, (SELECT count(*) FROM x WHERE s >= 0.5 AND f = 1) AS tp, (SELECT count(*) FROM x WHERE s >= 0.5 AND f = 0) AS fp, (SELECT count(*) FROM x WHERE s < 0.5 AND f = 1) AS fn,
    (SELECT round(avg(-(f * ln(greatest(1e-15, least(1 - 1e-15, s))) + (1 - f) * ln(1 - greatest(1e-15, least(1 - 1e-15, s))))), 4) FROM x) AS log_loss FROM c""")
def classifier_metrics(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumn("s", F.col("qty") / 50.0)
    out = stats.binary_metrics(own, "s", F.col("fraud"))
    return out.select(F.round("auc", 6).alias("auc"), F.round("ks", 6).alias("ks"), "tp", "fp", "fn", F.round("log_loss", 4).alias("log_loss"))


@query(_SCORE + "SELECT CAST(floor(fpr * 20) AS BIGINT) AS step, round(max(fpr), 6) AS fpr, round(max(tpr), 6) AS tpr, min(s) AS score FROM c GROUP BY 1")
def roc_curve(spark, sf_dir):
    out = stats.roc_curve(purchases(spark, sf_dir).withColumn("s", F.col("qty") / 50.0), "s", F.col("fraud"), 20)
    return out.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query(_SCORE + "SELECT s AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) AS youden FROM c ORDER BY tpr - fpr DESC, s DESC LIMIT 1")
def best_cut(spark, sf_dir):
    out = stats.best_cut(purchases(spark, sf_dir).withColumn("s", F.col("qty") / 50.0), "s", F.col("fraud"))
    return out.withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "youden")})


@query(T + "SELECT merchant, round(avg(amount), 4) AS mean FROM t WHERE indicator = 'N' GROUP BY merchant ORDER BY avg(amount) DESC, merchant LIMIT 50")
def review_list(spark, sf_dir):
    means = purchases(spark, sf_dir).filter("indicator = 'N'").groupBy("merchant").agg(F.avg("amount").alias("mean"))
    return rounded(rules.review_list(means, F.lit(True), "mean", "merchant"), "mean")


@query(T + ", x AS (SELECT min(amount) AS a, max(amount) AS b FROM t) SELECT mcc, round(avg((amount - a) / (b - a + 1e-9)), 6) AS mean_norm FROM t, x GROUP BY mcc")
def normalised_amounts(spark, sf_dir):
    return stats.min_max(purchases(spark, sf_dir), ["amount"]).groupBy("mcc").agg(F.round(F.avg("amount"), 6).alias("mean_norm"))

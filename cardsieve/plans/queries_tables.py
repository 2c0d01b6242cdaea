"""Queries that make analysis tables and BI measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import quantiles, stats, tables
from ..sources import medallion, schema
from ..sources.scratch import new_folder
from .registry import E, T, days_as_text, events, purchases, query, rounded, table


@query(T + """SELECT reason, count(*) FILTER (indicator = 'A') AS "n_A", count(*) FILTER (indicator = 'N') AS "n_N", count(*) FILTER (indicator = 'R') AS "n_R", count(*) AS total, round(count(*) FILTER (indicator = 'R') / count(*), 4) AS fraud_rate
    FROM t GROUP BY reason ORDER BY total DESC, reason LIMIT 4""")
def indicator_pivot(spark, sf_dir):
    return rounded(tables.pivot_indicator(purchases(spark, sf_dir), "reason", "indicator", ["A", "N", "R"], "R", 4), "fraud_rate")


@query(T + """SELECT mcc, count(DISTINCT client) FILTER (indicator = 'R') AS "clients_R", round(sum(amount) FILTER (indicator = 'R'), 2) AS "amount_R", round(avg(amount) FILTER (indicator = 'R'), 4) AS "ticket_R", round(sum(amount) FILTER (indicator = 'R') / sum(amount), 4) AS severity FROM t GROUP BY mcc""")
def clients_and_amounts(spark, sf_dir):
    out = tables.pivot_clients_amounts(purchases(spark, sf_dir), "mcc", "indicator", ["N", "R"], "R", "client", "amount")
    return rounded(out.select("mcc", "clients_R", F.round("amount_R", 2).alias("amount_R"), "ticket_R", "severity"), "ticket_R", "severity")


@query(T + """, l AS (SELECT indicator, 'amount' AS variable, amount AS x FROM t UNION ALL SELECT indicator, 'qty', qty FROM t UNION ALL SELECT indicator, 'discount', discount FROM t)
    SELECT variable, indicator, count(x) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(quantile_cont(x, 0.9), 4) AS p90 FROM l GROUP BY ALL""")
def stats_by_indicator(spark, sf_dir):
    return rounded(tables.stats_by_indicator(purchases(spark, sf_dir), "indicator", ["amount", "qty", "discount"]), "mean", "median", "p90")


@query(T + """SELECT coalesce(strftime(ts, '%Y-%m'), 'TOTAL') AS period, count(*) AS n, round(sum(amount), 2) AS amount, sum(CAST(fraud AS INT)) AS frauds, round(coalesce(sum(amount) FILTER (fraud), 0), 2) AS fraud_amount, round(sum(amount) / count(*), 4) AS ticket, round(sum(CAST(fraud AS INT)) / count(*), 6) AS fraud_rate,
    count(*) FILTER (indicator = 'N') AS "n_N", round(coalesce(sum(amount) FILTER (indicator = 'N'), 0), 2) AS "amount_N", round(coalesce(avg(amount) FILTER (indicator = 'N'), 0), 4) AS "ticket_N",
    count(*) FILTER (indicator = 'R') AS "n_R", round(coalesce(sum(amount) FILTER (indicator = 'R'), 0), 2) AS "amount_R", round(coalesce(avg(amount) FILTER (indicator = 'R'), 0), 4) AS "ticket_R" FROM t GROUP BY ROLLUP (strftime(ts, '%Y-%m'))""")
def summary_by_month(spark, sf_dir):
    out = tables.summary_by_period(purchases(spark, sf_dir), F.date_format("ts", "yyyy-MM"), "amount", F.col("fraud"), "indicator", ["N", "R"])
    out = out.withColumns({c: F.round(c, 2) for c in ("amount", "fraud_amount", "amount_N", "amount_R")}).withColumn("fraud_rate", F.round("fraud_rate", 6))
    return rounded(out, "ticket", "ticket_N", "ticket_R")


@query(T + "SELECT reason, mcc, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds, round(sum(CAST(fraud AS INT)) / count(*), 4) AS rate FROM t GROUP BY ALL")
def reason_by_category(spark, sf_dir):
    return rounded(tables.cross_tab(purchases(spark, sf_dir), "reason", "mcc", F.col("fraud")), "rate")


@query(T + """SELECT indicator, count(amount) AS n, round(sum(amount), 2) AS sum, round(avg(amount), 4) AS mean, round(stddev_samp(amount), 4) AS std, min(amount) AS min, max(amount) AS max, round(quantile_cont(amount, 0.1), 4) AS p10, round(quantile_cont(amount, 0.5), 4) AS p50, round(quantile_cont(amount, 0.99), 4) AS p99 FROM t GROUP BY indicator""")
def amount_statistics(spark, sf_dir):
    out = tables.amount_stats(purchases(spark, sf_dir), ["indicator"], "amount")
    return rounded(out.select("indicator", "n", F.round("sum", 2).alias("sum"), "mean", "std", "min", "max", "p10", "p50", "p99"), "mean", "std", "p10", "p50", "p99")


_DECILES = T + """, q AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS inner_edges FROM t),
    b AS (SELECT t.*, 1 + len(list_filter(inner_edges, lambda x: x < amount)) AS decile FROM t, q)"""


@query(_DECILES + "SELECT decile, count(*) AS n, round(sum(amount), 2) AS sum, min(amount) AS min, max(amount) AS max, round(median(amount), 4) AS median, sum(CAST(fraud AS INT)) AS frauds, round(sum(CAST(fraud AS INT)) / count(*), 4) AS rate FROM b GROUP BY decile")
def amount_deciles(spark, sf_dir):
    out = tables.decile_table(purchases(spark, sf_dir), "amount", F.col("fraud"))
    return rounded(out.withColumn("sum", F.round("sum", 2)), "median", "rate")


@query(T + """, q AS (SELECT bin, quantile_cont(amount, [0.25, 0.5, 0.75]) AS cut FROM t GROUP BY bin), b AS (SELECT t.bin, 1 + len(list_filter(cut, lambda x: x < amount)) AS decile, amount, fraud FROM t JOIN q USING (bin))
    SELECT bin, decile, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds FROM b GROUP BY ALL""")
def quartiles_of_bins(spark, sf_dir):
    return tables.decile_table(purchases(spark, sf_dir), "amount", F.col("fraud"), ["bin"], 4, medians=False).select("bin", "decile", "n", "frauds")


@query(T + """, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.5) AS b, quantile_cont(amount, 0.75) AS c FROM t) SELECT CASE WHEN amount <= a THEN 'q1' WHEN amount <= b THEN 'q2' WHEN amount <= c THEN 'q3' ELSE 'q4' END AS class, count(*) AS n FROM t, q GROUP BY 1""")
def quartile_classes(spark, sf_dir):
    own = purchases(spark, sf_dir)
    cuts = F.broadcast(quantiles.percentiles(own, "amount", (0.25, 0.5, 0.75), "c"))
    kind = bands.percentile_class(F.col("amount"), [F.col("c")[k] for k in range(3)], ["q1", "q2", "q3", "q4"])
    return own.crossJoin(cuts).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(T + """, c AS (SELECT unnest([0.5, 0.75, 0.9, 0.95]) AS point), f AS (SELECT point, (SELECT quantile_cont(amount, 0.5) FROM t WHERE fraud) AS p50, (SELECT quantile_cont(amount, 0.75) FROM t WHERE fraud) AS p75, (SELECT quantile_cont(amount, 0.9) FROM t WHERE fraud) AS p90, (SELECT quantile_cont(amount, 0.95) FROM t WHERE fraud) AS p95 FROM c),
    g AS (SELECT point, CASE point WHEN 0.5 THEN p50 WHEN 0.75 THEN p75 WHEN 0.9 THEN p90 ELSE p95 END AS cut FROM f)
    SELECT CAST(point AS DOUBLE) AS point, round(cut, 4) AS cut, round((SELECT avg(CASE WHEN amount <= cut THEN 1.0 ELSE 0.0 END) FROM t WHERE NOT fraud), 4) AS others_below FROM g""")
def optimal_range(spark, sf_dir):
    return rounded(tables.optimal_range(purchases(spark, sf_dir), "amount", F.col("fraud")), "cut", "others_below")


@query(T + """SELECT CASE WHEN amount < 20000 THEN 'low' WHEN amount < 60000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds, round(sum(CAST(fraud AS INT)) / count(*), 4) AS rate,
    CASE WHEN sum(CAST(fraud AS INT)) / count(*) >= 0.34 THEN 'red' WHEN sum(CAST(fraud AS INT)) / count(*) >= 0.33 THEN 'amber' ELSE 'green' END AS light FROM t WHERE amount >= 0 GROUP BY 1""")
def amount_bands(spark, sf_dir):
    out = tables.band_table(purchases(spark, sf_dir), "amount", [(0, 20000, "low"), (20000, 60000, "mid"), (60000, 1e9, "high")], F.col("fraud"), 0.33, 0.34)
    return rounded(out.select("band", "n", "frauds", "rate", "light"), "rate")


@query(T + """SELECT reason, count(*) FILTER (fraud) AS frauds, round(median(amount) FILTER (fraud), 4) AS median_fraud, round(quantile_cont(amount, 0.9) FILTER (fraud), 4) AS p90_fraud, round(median(amount) FILTER (NOT fraud), 4) AS median_other,
    round(median(amount) FILTER (fraud) / median(amount) FILTER (NOT fraud), 4) AS ratio FROM t GROUP BY reason HAVING count(*) FILTER (fraud) >= 2""")
def amounts_by_reason(spark, sf_dir):
    out = tables.amount_interaction(purchases(spark, sf_dir), "reason", "amount", F.col("fraud"))
    return rounded(out.select("reason", "frauds", "median_fraud", "p90_fraud", "median_other", "ratio"), "median_fraud", "p90_fraud", "median_other", "ratio")


@query(T + """, g AS (SELECT bin, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds, round(avg(amount) FILTER (fraud), 4) AS mean_fraud, max(amount) FILTER (fraud) AS max_fraud FROM t GROUP BY bin ORDER BY n DESC, bin LIMIT 10),
    m AS (SELECT bin, reason, count(*) AS c FROM t GROUP BY bin, reason QUALIFY row_number() OVER (PARTITION BY bin ORDER BY c DESC, reason) = 1) SELECT g.*, reason AS mode_reason FROM g JOIN m USING (bin)""")
def largest_bins(spark, sf_dir):
    return rounded(tables.bin_centric(purchases(spark, sf_dir), "bin", "amount", F.col("fraud"), ["reason"]), "mean_fraud")


@query(T + """, q AS (SELECT quantile_cont(amount, [0.9, 0.95, 0.97, 0.99, 1.0]) AS c FROM t), b AS (SELECT amount, fraud, CASE WHEN amount > c[1] AND amount <= c[2] THEN 'p90-p95' WHEN amount > c[2] AND amount <= c[3] THEN 'p95-p97' WHEN amount > c[3] AND amount <= c[4] THEN 'p97-p99' WHEN amount > c[4] THEN 'p99-p100' END AS band FROM t, q)
    SELECT band, count(*) AS n, round(sum(amount), 2) AS amount, sum(CAST(fraud AS INT)) AS frauds FROM b WHERE band IS NOT NULL GROUP BY band""")
def top_decile(spark, sf_dir):
    return tables.top_decile_opening(purchases(spark, sf_dir), "amount", F.col("fraud")).withColumn("amount", F.round("amount", 2))


@query(T + """, g AS (SELECT avg(CAST(fraud AS INT)) AS rate FROM t) SELECT reason, mcc, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds, count(DISTINCT client) AS clients, round(avg(CAST(fraud AS INT)) / any_value(rate), 4) AS lift, round(sum(amount) FILTER (fraud) / sum(amount), 4) AS severity, round(avg(amount), 4) AS ticket
    FROM t, g GROUP BY reason, mcc ORDER BY frauds DESC, n DESC, reason, mcc LIMIT 50""")
def group_summary(spark, sf_dir):
    out = tables.group_summary(purchases(spark, sf_dir), ["reason", "mcc"], "client", "amount", F.col("fraud"))
    return rounded(out.select("reason", "mcc", "n", "frauds", "clients", "lift", "severity", "ticket"), "lift", "severity", "ticket")


@query(T + "SELECT reason, mcc, count(*) AS n, round(sum(amount), 2) AS amount, count(DISTINCT client) AS clients FROM t WHERE NOT approved GROUP BY reason, mcc ORDER BY n DESC, reason, mcc LIMIT 30")
def decline_reasons(spark, sf_dir):
    out = tables.decline_reasons(purchases(spark, sf_dir).filter("not approved"), "reason", "client", "amount", "mcc", 30)
    return out.withColumn("amount", F.round("amount", 2))


@query(E + ", n AS (SELECT k, d, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT k, sum(n) AS s FROM n GROUP BY k ORDER BY s DESC, k LIMIT 15) SELECT k, CAST(d AS VARCHAR) AS day, n FROM n JOIN t USING (k)")
def range_heatmap(spark, sf_dir):
    return days_as_text(tables.day_heatmap(events(spark, sf_dir), "k", "ts"), "day")


@query(T + ", g AS (SELECT reason, merchant, count(*) AS n FROM t GROUP BY ALL) SELECT reason, merchant, n, dense_rank() OVER (PARTITION BY reason ORDER BY n DESC) AS rank FROM g")
def merchant_ranks(spark, sf_dir):
    return tables.ranked_counts(purchases(spark, sf_dir), "reason", "merchant")


@query(T + """, l AS (SELECT reason, coalesce(CAST(nullif(merchant % 9, 0) AS VARCHAR), 'NO_VALUE') AS item, CAST(strftime(ts, '%Y') AS INT) % 3 AS day FROM t), g AS (SELECT reason AS "group", item, count(*) AS total, count(DISTINCT day) AS days FROM l WHERE reason IS NOT NULL GROUP BY ALL)
    SELECT *, dense_rank() OVER (PARTITION BY "group" ORDER BY total DESC) AS rank FROM g""")
def merchant_log_ranks(spark, sf_dir):
    """Three loads; the second is run twice, first with half of its rows, as after a broken run."""
    path = new_folder(spark, "merchant-log")
    own = purchases(spark, sf_dir).select("reason", F.nullif(F.col("merchant") % 9, F.lit(0)).alias("item"), (F.year("ts") % 3).alias("day"), "amount")
    loads = [("0", F.col("day") == 0), ("1", (F.col("day") == 1) & (F.col("amount") > 30000)), ("1", F.col("day") == 1), ("2", F.col("day") == 2)]
    for day, rows in loads:
        tables.log_counts(own.filter(rows).drop("day"), path, day, "reason", "item")
    return tables.ranked_log(spark, path)


@query(T + ", g AS (SELECT reason, mcc, sum(amount) AS v FROM t GROUP BY ALL) SELECT reason, mcc, round(v, 2) AS value, round(v / sum(v) OVER (), 6) AS share, round(v / sum(v) OVER (PARTITION BY reason), 6) AS share_within FROM g")
def amount_shares(spark, sf_dir):
    out = tables.share_of_total(purchases(spark, sf_dir), ["reason", "mcc"], F.sum("amount"), ["reason"])
    return out.select("reason", "mcc", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"), F.round("share_within", 6).alias("share_within"))


@query(T + ", g AS (SELECT merchant, sum(amount) AS x FROM t GROUP BY merchant) SELECT round((SELECT sum(x) FROM (SELECT x FROM g ORDER BY x DESC, merchant LIMIT 10)) / sum(x), 6) AS concentration FROM g")
def merchant_concentration(spark, sf_dir):
    return tables.top_concentration(purchases(spark, sf_dir), "merchant", "amount").select(F.round("concentration", 6).alias("concentration"))


@query(T + ", m AS (SELECT date_trunc('month', ts) AS m, sum(amount) AS v FROM t GROUP BY 1) SELECT strftime(a.m, '%Y-%m') AS month, round(a.v, 2) AS value, round(b.v, 2) AS previous, round((a.v - b.v) / b.v, 6) AS change FROM m a LEFT JOIN m b ON b.m = a.m - INTERVAL 1 MONTH")
def month_over_month(spark, sf_dir):
    out = tables.month_over_month(purchases(spark, sf_dir), "ts", F.sum("amount"))
    return out.select("month", F.round("value", 2).alias("value"), F.round("previous", 2).alias("previous"), F.round("change", 6).alias("change"))


@query(E + "SELECT hour(ts) AS bucket, count(*) AS n FROM e WHERE err GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def peak_hour(spark, sf_dir):
    return tables.peak_bucket(events(spark, sf_dir), F.hour("ts"), F.col("err"))


@query(T + ", g AS (SELECT client, sum(amount) AS m FROM t GROUP BY client) SELECT round(avg(m), 4) AS mean, count(*) AS keys FROM g")
def mean_of_clients(spark, sf_dir):
    return rounded(tables.mean_of_group_measures(purchases(spark, sf_dir), "client", F.sum("amount")), "mean")


@query(T + "SELECT reason, round(avg(CAST(fraud AS INT)), 6) AS row_share, round(count(DISTINCT client) FILTER (fraud) / count(DISTINCT client), 6) AS card_share, round(sum(amount) FILTER (fraud) / sum(amount), 6) AS amount_share FROM t GROUP BY reason")
def fraud_shares(spark, sf_dir):
    out = tables.conditional_ratios(purchases(spark, sf_dir), F.col("fraud"), "client", "amount", ["reason"])
    return out.withColumns({c: F.round(c, 6) for c in ("row_share", "card_share", "amount_share")})


@query(T + "SELECT count(*) AS n, round(sum(amount), 2) AS amount, count(DISTINCT client) AS cards, count(DISTINCT merchant) AS merchants, round(avg(amount), 4) AS ticket FROM t")
def base_measures(spark, sf_dir):
    return rounded(tables.base_measures(purchases(spark, sf_dir), "client", "merchant", "amount").withColumn("amount", F.round("amount", 2)), "ticket")


@query(T + """, m AS (SELECT *, amount / 4 AS usd, CASE WHEN mcc % 3 = 0 THEN amount / 4 ELSE amount END AS original FROM t) SELECT bin, count(*) AS n, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS declined, round(avg(CAST(approved AS INT)), 6) AS approval_rate, count(*) FILTER (substr(reason, 1, 1) = '1') AS code_1, sum(CAST(fraud AS INT)) AS frauds,
    round(coalesce(sum(amount) FILTER (approved), 0), 2) AS approved_amount, round(coalesce(sum(amount) FILTER (approved AND original = amount), 0), 2) AS approved_local, round(coalesce(sum(amount) FILTER (NOT approved AND original = amount), 0), 2) AS declined_local,
    round(coalesce(sum(usd) FILTER (approved AND original = usd), 0), 2) AS approved_usd, round(coalesce(sum(usd) FILTER (NOT approved AND original = usd), 0), 2) AS declined_usd FROM m GROUP BY bin""")
def approval_matrix(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumns({"code": F.substring("reason", 1, 1), "usd": F.col("amount") / 4})
    own = own.withColumn("original", F.when(F.col("mcc") % 3 == 0, F.col("usd")).otherwise(F.col("amount")))
    out = tables.approval_matrix(own, "bin", F.col("approved"), "code", "amount", F.col("fraud"), ("1", "2"), "original", {"local": "amount", "usd": "usd"})
    money = [F.round(c, 2).alias(c) for c in ("approved_amount", "approved_local", "declined_local", "approved_usd", "declined_usd")]
    return out.select("bin", "n", "approved", "declined", F.round("approval_rate", 6).alias("approval_rate"), "code_1", "frauds", *money)


@query(T + """SELECT reason, round(avg(date_diff('day', CAST(ts AS DATE), CAST(closed AS DATE))), 4) AS mean_days, round(avg(CASE WHEN date_diff('day', CAST(ts AS DATE), CAST(closed AS DATE)) <= 7 THEN 1.0 ELSE 0.0 END), 6) AS within_week, round(coalesce(sum(amount) FILTER (closed IS NULL), 0), 2) AS pending_amount FROM t GROUP BY reason""")
def case_closing(spark, sf_dir):
    out = tables.case_closing(purchases(spark, sf_dir), "ts", "closed", "amount", ["reason"])
    return rounded(out.select("reason", "mean_days", F.round("within_week", 6).alias("within_week"), F.round("pending_amount", 2).alias("pending_amount")), "mean_days")


@query(T + """, l AS (SELECT 'reason' AS dimension, reason AS value, fraud FROM t UNION ALL SELECT 'mcc', CAST(mcc AS VARCHAR), fraud FROM t) SELECT dimension, value, count(*) AS n, sum(CAST(fraud AS INT)) AS frauds, round(avg(CAST(fraud AS INT)), 6) AS rate FROM l GROUP BY ALL HAVING count(*) >= 20""")
def rates_by_dimension(spark, sf_dir):
    return tables.flag_lift(purchases(spark, sf_dir), ["reason", "mcc"], F.col("fraud")).withColumn("rate", F.round("rate", 6))


@query(E + ", g AS (SELECT d, k, count(DISTINCT user_id) AS cards FROM e GROUP BY ALL HAVING count(DISTINCT user_id) >= 3) SELECT CAST(d AS VARCHAR) AS day, count(*) AS ranges, max(cards) AS most_cards FROM g GROUP BY d ORDER BY ranges DESC, d LIMIT 10")
def card_testing_days(spark, sf_dir):
    return days_as_text(tables.card_testing_days(events(spark, sf_dir), "k", "ts", "user_id", 10, 3), "day")


@query(E + ", g AS (SELECT d, k, count(DISTINCT user_id) AS cards, count(*) AS n FROM e WHERE k IS NOT NULL GROUP BY ALL HAVING count(DISTINCT user_id) >= 2) SELECT cards, sum(n) AS n, count(*) AS range_days FROM g GROUP BY cards")
def cards_per_range(spark, sf_dir):
    return tables.cards_per_range(events(spark, sf_dir), "k", "ts", "user_id")


@query(T + ", g AS (SELECT bin, count(amount) AS n, sum(CAST(fraud AS INT)) AS frauds FROM t WHERE bin IS NOT NULL GROUP BY bin HAVING count(amount) >= 10) SELECT bin, n, frauds, round(100 * (frauds / CAST(n AS DOUBLE)), 2) AS rate FROM g ORDER BY rate DESC, bin LIMIT 20")
def bins_by_fraud_rate(spark, sf_dir):
    return tables.ranges_by_rate(purchases(spark, sf_dir), "bin", F.col("fraud"), "amount", 20)


@query(T + "SELECT merchant, count(DISTINCT CAST(ts AS DATE)) FILTER (fraud) AS fraud_days, min(amount) AS min_ticket, max(amount) AS max_ticket, count(DISTINCT client) AS cards, round(sum(CAST(fraud AS INT)) / count(DISTINCT client), 6) AS frauds_per_card, round(avg(CASE WHEN qty > 25 THEN 1.0 ELSE 0.0 END), 6) AS burst_share FROM t GROUP BY merchant")
def merchant_detail(spark, sf_dir):
    out = tables.merchant_detail(purchases(spark, sf_dir), "merchant", "ts", "client", "amount", F.col("fraud"), F.col("qty") > 25)
    return out.withColumns({c: F.round(c, 6) for c in ("frauds_per_card", "burst_share")})


@query(T + """, g AS (SELECT client, CAST(ts AS DATE) AS d, indicator, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT indicator, CASE WHEN n >= 6 THEN '6+' ELSE CAST(n AS VARCHAR) END AS bucket, sum(n) AS rows, count(DISTINCT client) AS clients FROM g GROUP BY ALL)
    SELECT indicator, bucket, rows, clients, round(rows / sum(rows) OVER (PARTITION BY indicator), 6) AS share FROM b""")
def client_day_counts(spark, sf_dir):
    return tables.client_day_buckets(purchases(spark, sf_dir), "client", "ts", "indicator").withColumn("share", F.round("share", 6))


@query(E + "SELECT CAST(d AS VARCHAR) AS day, round(median(value), 4) AS median, count(value) AS n FROM e GROUP BY d")
def daily_median_value(spark, sf_dir):
    return days_as_text(rounded(tables.daily_median(events(spark, sf_dir), "ts", "value"), "median"), "day")


@query(T + ", g AS (SELECT reason, merchant, sum(amount) AS x FROM t GROUP BY ALL) SELECT reason, merchant, row_number() OVER (PARTITION BY reason ORDER BY x DESC, merchant) AS place FROM g QUALIFY place <= 5")
def top_merchants_of_reason(spark, sf_dir):
    sums = purchases(spark, sf_dir).groupBy("reason", "merchant").agg(F.sum("amount").alias("x"))
    return tables.top_per_group(sums, ["reason"], [F.desc("x"), F.asc("merchant")], 5).select("reason", "merchant", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS number, CAST(ceil(row_number() OVER (ORDER BY o_orderdate, o_orderkey) / 800.0) AS BIGINT) AS chunk FROM orders")
def numbered_orders(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return tables.numbered(own, ["o_orderdate", "o_orderkey"], 1000, 800).select("o_orderkey", "number", "chunk")


@query("SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 100")
def review_sample(spark, sf_dir):
    return tables.steady_sample(table(spark, sf_dir, "orders"), "o_orderkey", 100)


@query("SELECT * FROM (VALUES ('o_clerk', 'missing'), ('o_custkey', 'common'), ('o_note', 'added'), ('o_orderkey', 'common')) v(\"column\", status)")
def schema_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return schema.drift_table(o.withColumn("o_note", F.lit("x")), o.withColumn("o_clerk", F.lit("x")))


@query("""SELECT CAST(c_custkey AS DOUBLE) AS key, c_name AS name, NULL AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS DOUBLE) AS key, s_name, 'supplier' FROM supplier""")
def aligned_union(spark, sf_dir):
    c = schema.rename_by_map(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double"), "c_name"), {"c_custkey": "key", "c_name": "name"})
    s = schema.resolve_synonyms(table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "Clave", "s_name": "Nómbre "}), {"key": ["clave"], "name": ["nombre"]}).withColumn("segment", F.lit("supplier"))
    return schema.union_all([c, s])


@query("SELECT o_orderstatus AS source, count(*) AS rows, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, CAST(0 AS DOUBLE) AS null_share FROM orders GROUP BY 1")
def load_summary(spark, sf_dir):
    out = medallion.load_summary(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate")
    return days_as_text(out.withColumnRenamed("o_orderstatus", "source"), "first_day", "last_day")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS report_month, strftime(o_orderdate, '%d') AS report_dd FROM orders WHERE o_orderstatus NOT IN ('P') AND o_orderpriority NOT IN ('5-LOW') AND o_orderstatus = 'F'""")
def gold_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns(medallion.report_period(F.col("o_orderdate")))
    out = medallion.gold_debit(o, ["o_orderkey", "report_month", "report_dd", "o_orderstatus"], ["P"], ["5-LOW"], "o_orderstatus", "o_orderpriority", "o_orderstatus")
    return medallion.gold_by_result(out, ["o_orderkey", "report_month", "report_dd"], "o_orderstatus", ["F"])


@query("""WITH m AS (SELECT o_orderkey, o_orderdate AS ts, o_orderstatus AS source, CAST(o_custkey AS VARCHAR) AS bin FROM orders) SELECT o_orderkey, substr(bin, 1, 6) AS bin6, CASE WHEN source = 'F' THEN '07' END AS entry_mode, source || '|' || substr(bin, 1, 6) || '|' || strftime(ts, '%Y%m%d') AS key FROM m
    WHERE ts >= TIMESTAMP '1996-01-01' AND (source <> 'O' OR ts >= TIMESTAMP '1998-01-01')""")
def declines_master(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("source"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("bin"), F.lit(None).cast("string").alias("entry_mode"))
    return medallion.post_process(m, "1996-01-01", {"O": "1998-01-01"}, {"F": "07"}).select("o_orderkey", "bin6", "entry_mode", "key")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_orders(spark, sf_dir):
    return schema.deduplicate(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(T + ", x AS (SELECT abs(amount - 40000) AS a FROM t), q AS (SELECT quantile_cont(a, 0.25) AS lo, quantile_cont(a, 0.75) AS hi FROM x) SELECT count(*) AS n, round(any_value(hi + 0.2 * (hi - lo)), 4) AS cut FROM x, q WHERE a > hi + 0.2 * (hi - lo)")
def outlying_amounts(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumn("x", F.col("amount") - 40000)
    return stats.iqr_outliers(own, "x", 0.2).agg(F.count(F.lit(1)).alias("n"), F.round(F.first("limit"), 4).alias("cut"))


@query(T + ", x AS (SELECT strftime(closed, '%Y-%m') AS month, date_diff('day', CAST(ts AS DATE), CAST(closed AS DATE)) AS delay, amount FROM t) SELECT month, CASE WHEN delay <= 7 THEN '0-7' WHEN delay <= 60 THEN '8-60' ELSE '61+' END AS delay_band, count(*) AS n, round(sum(amount), 2) AS amount FROM x WHERE delay >= 0 GROUP BY ALL")
def claims_by_delay(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumns({"month": F.date_format("closed", "yyyy-MM"), "delay": F.date_diff(F.to_date("closed"), F.to_date("ts"))}).filter("delay >= 0")
    return own.groupBy("month", bands.banded(F.col("delay"), (-1, 7, 60, 99999), ("0-7", "8-60", "61+")).alias("delay_band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(T + """, x AS (SELECT *, strftime(closed, '%Y-%m') AS month, date_diff('day', CAST(ts AS DATE), CAST(closed AS DATE)) AS delay, CAST(qty AS BIGINT) % 10 AS score FROM t), y AS (SELECT *, CASE WHEN delay <= 7 THEN '0-7' WHEN delay <= 60 THEN '8-60' ELSE '61+' END AS delay_band FROM x WHERE delay >= 0),
    l AS (SELECT 'month' AS dimension, month AS value, amount, delay FROM y UNION ALL SELECT 'channel', reason, amount, delay FROM y UNION ALL SELECT 'mcc', CAST(mcc AS VARCHAR), amount, delay FROM y UNION ALL SELECT 'merchant', CAST(merchant AS VARCHAR), amount, delay FROM y
    UNION ALL SELECT 'bin', CAST(bin AS VARCHAR), amount, delay FROM y UNION ALL SELECT 'delay_band', delay_band, amount, delay FROM y UNION ALL SELECT 'score', CAST(score AS VARCHAR), amount, delay FROM y)
    SELECT dimension, value, count(amount) AS n, round(sum(amount), 2) AS amount, round(avg(amount), 4) AS mean, round(count(*) / (SELECT count(*) FROM y), 6) AS share, median(delay) AS median_delay FROM l WHERE value IS NOT NULL GROUP BY ALL""")
def claims_by_dimension(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumns({"month": F.date_format("closed", "yyyy-MM"), "delay": F.date_diff(F.to_date("closed"), F.to_date("ts")), "channel": F.col("reason"), "score": F.col("qty").cast("bigint") % 10}).filter("delay >= 0")
    own = own.withColumn("delay_band", bands.banded(F.col("delay"), (-1, 7, 60, 99999), ("0-7", "8-60", "61+")))
    out = tables.claims_by(own, ["month", "channel", "mcc", "merchant", "bin", "delay_band", "score"], "amount", "delay")
    return rounded(out.withColumns({"amount": F.round("amount", 2), "share": F.round("share", 6)}), "mean")


@query(E + "SELECT e.event_id, CASE WHEN n.tier = 'a' THEN 1 ELSE 0 END AS in_tier FROM e LEFT JOIN (SELECT unnest([1, 2, 3]) AS k, 'a' AS tier) n USING (k)")
def code_expansion(spark, sf_dir):
    codes = spark.createDataFrame([("1+2+3", "a")], "code string, tier string")
    expanded = stats.expand_codes(codes, "code").select(F.col("code").cast("bigint").alias("k"), "tier")
    return events(spark, sf_dir).join(F.broadcast(expanded), "k", "left").select("event_id", F.coalesce((F.col("tier") == "a").cast("int"), F.lit(0)).alias("in_tier"))



"""Queries on daily series, alerts and their attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import Calendar
from ..operators import attribution, series, stats
from .registry import E, T, days_as_text, events, purchases, query, rounded

_DENSE = E + """, n AS (SELECT event_type, d AS day, count(*) AS n, sum(value) AS total FROM e GROUP BY ALL),
    span AS (SELECT event_type, min(day) AS a, (SELECT max(day) FROM n) AS b FROM n GROUP BY event_type),
    days AS (SELECT event_type, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    s AS (SELECT days.event_type, days.day, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM days LEFT JOIN n USING (event_type, day))"""
_ROBUST = _DENSE + """, w AS (SELECT *, count(*) OVER p AS held, median(n) OVER p AS med, mad(n) OVER p AS dev FROM s
                            WINDOW p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT event_type, day, n, CASE WHEN held >= 7 THEN med END AS median, CASE WHEN held >= 7 THEN dev END AS mad,
          CASE WHEN held >= 7 THEN 0.6745 * (n - med) / greatest(dev, 1) END AS z FROM w)"""


def _daily(spark, sf_dir):
    return series.densify(series.daily_series(events(spark, sf_dir), ["event_type"], "ts", {"n": F.count(F.lit(1)), "total": F.sum("value")}), ["event_type"], ["n", "total"])


@query(_ROBUST + " SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(median, 9) AS median, round(mad, 9) AS mad, round(z, 9) AS z, CASE WHEN z > 4 AND n >= 10 AND n > median THEN 1 ELSE 0 END AS alert FROM z")
def robust_z_series(spark, sf_dir):
    out = series.robust_z(_daily(spark, sf_dir), ["event_type"], "n")
    return days_as_text(rounded(out.select("event_type", "day", "n", "median", "mad", "z", "alert"), "median", "mad", "z", digits=9), "day")


@query(_ROBUST + " SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(z, 9) AS z FROM z WHERE z > 2 AND n > median")
def robust_z_alerts(spark, sf_dir):
    out = series.robust_z(_daily(spark, sf_dir), ["event_type"], "n", z=2.0).filter("alert = 1 or (z > 2 and n > median)")
    return days_as_text(rounded(out.select("event_type", "day", "n", "z"), "z", digits=9), "day")


@query(_DENSE + " SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(total, 4) AS total FROM s")
def densified_series(spark, sf_dir):
    return days_as_text(rounded(_daily(spark, sf_dir), "total"), "day")


@query(E + """ SELECT event_type, CAST(d AS VARCHAR) AS day, count(*) AS n_trx, count(DISTINCT user_id) AS n_cards, round(count(*) / count(DISTINCT user_id), 4) AS trx_per_card,
    round(avg(CASE WHEN k % 2 = 0 THEN 0.0 ELSE 1.0 END), 4) AS decline_rate, round(avg(value) FILTER (k % 2 = 0), 4) AS mean_ticket, round(coalesce(sum(value) FILTER (k % 2 = 0), 0), 4) AS approved_amount,
    count(DISTINCT k) AS n_mcc, count(DISTINCT k % 10) AS n_merchants, round(avg(CASE WHEN hour(ts) < 6 THEN 1.0 ELSE 0.0 END), 4) AS night_share FROM e GROUP BY event_type, d""")
def daily_measures(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("m", F.col("k") % 10)
    out = series.daily_series(own, ["event_type"], "ts", series.transaction_measures("user_id", "value", F.col("k") % 2 == 0, "m", "k", "ts"))
    return days_as_text(rounded(out, "trx_per_card", "decline_rate", "mean_ticket", "approved_amount", "night_share"), "day")


@query(E + """, a AS (SELECT 'type' AS level, event_type AS key, d AS day, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'type_parity', event_type || ' / ' || CAST(k % 2 AS VARCHAR), d, count(*) FROM e GROUP BY ALL),
    span AS (SELECT level, key, min(day) AS f FROM a GROUP BY ALL), ends AS (SELECT level, max(day) AS l FROM a GROUP BY level),
    days AS (SELECT level, key, CAST(unnest(generate_series(CAST(f AS TIMESTAMP), CAST(l AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span JOIN ends USING (level)),
    s AS (SELECT days.*, coalesce(n, 0) AS n FROM days LEFT JOIN a USING (level, key, day)),
    w AS (SELECT *, count(*) OVER p AS held, median(n) OVER p AS med, mad(n) OVER p AS dev FROM s WINDOW p AS (PARTITION BY level, key ORDER BY day ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))
    SELECT level, key, CAST(day AS VARCHAR) AS day, n, CASE WHEN held >= 7 THEN round(0.6745 * (n - med) / greatest(dev, 1), 9) END AS z FROM w""")
def multi_level_scores(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("parity", F.col("k") % 2)
    out = series.multi_level(own, {"type": ["event_type"], "type_parity": ["event_type", "parity"]}, "ts", {"n": F.count(F.lit(1))}, "n", ["n"])
    return days_as_text(rounded(out.select("level", "key", "day", "n", "z"), "z", digits=9), "day")


@query(_DENSE + """, w AS (SELECT *, count(n) OVER p AS held, avg(n) OVER p AS m, stddev_samp(n) OVER p AS sd, avg(total) OVER p AS m2, stddev_samp(total) OVER p AS sd2 FROM s
       WINDOW p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT event_type, day, n, CASE WHEN held >= 3 THEN (n - m) / nullif(sd, 0) END AS z_n, CASE WHEN held >= 3 THEN (total - m2) / nullif(sd2, 0) END AS z_total FROM w WHERE day = (SELECT max(day) FROM s))
    SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(z_n, 4) AS z_n, round(z_total, 4) AS z_total, round(greatest(abs(coalesce(z_n, 0)), abs(coalesce(z_total, 0))), 4) AS max_z FROM z""")
def rolling_z_last_day(spark, sf_dir):
    out = series.rolling_z(_daily(spark, sf_dir), ["event_type"], ["n", "total"])
    return days_as_text(rounded(out.select("event_type", "day", "n", "z_n", "z_total", "max_z"), "z_n", "z_total", "max_z"), "day")


@query(E + """, x AS (SELECT *, date_diff('day', d, (SELECT max(d) FROM e)) AS age FROM e)
    SELECT event_type, CASE WHEN age < 7 THEN 'recent' ELSE 'baseline' END AS period, count(*) AS n, round(sum(value), 4) AS total FROM x WHERE age < 21 GROUP BY ALL""")
def recent_against_baseline(spark, sf_dir):
    out = series.trailing(events(spark, sf_dir), "ts", 7, 14).groupBy("event_type", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total")


@query(E + """, g AS (SELECT user_id, d, count(*) AS n, sum(value) AS total FROM e GROUP BY ALL), l AS (SELECT user_id, max(d) AS d FROM g GROUP BY user_id)
    SELECT user_id, CAST(d AS VARCHAR) AS day, n, round(total, 4) AS total FROM g JOIN l USING (user_id, d)""")
def latest_day_of_client(spark, sf_dir):
    return days_as_text(rounded(series.latest_per_group(events(spark, sf_dir), "user_id", "ts", {"n": F.count(F.lit(1)), "total": F.sum("value")}), "total"), "day")


@query(E + """, n AS (SELECT user_id, d AS day, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT user_id, sum(n) AS total, median(n) AS median FROM n GROUP BY user_id ORDER BY total DESC, user_id LIMIT 15)
    SELECT user_id, CAST(day AS VARCHAR) AS day, n, median, round(n / median, 4) AS ratio FROM n JOIN t USING (user_id) WHERE n > 2 * median""")
def spikes_against_median(spark, sf_dir):
    daily = series.daily_series(events(spark, sf_dir), ["user_id"], "ts", {"n": F.count(F.lit(1))})
    return days_as_text(rounded(series.spike_vs_median(daily, "user_id", "n", times=2.0), "ratio"), "day")


@query(T + """, x AS (SELECT *, date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM t)) AS age FROM t), y AS (SELECT * FROM x WHERE age < 90),
    g AS (SELECT merchant, count(*) FILTER (age < 30) AS n_recent, count(*) FILTER (age >= 30) AS n_base, avg(amount) FILTER (age < 30) AS mr, avg(amount) FILTER (age >= 30) AS mb, stddev_samp(amount) FILTER (age >= 30) AS sb FROM y GROUP BY merchant HAVING count(*) FILTER (age < 30) > 0)
    SELECT merchant, n_recent, n_base, round(CASE WHEN n_base > 0 THEN (n_recent / 30.0) / (n_base / 60.0) ELSE 999 END, 4) AS volume_ratio, CAST(n_base = 0 AS INT) AS is_ghost,
    CAST(n_base > 0 AND n_recent / 30.0 >= 3 * (n_base / 60.0) AND n_recent >= 2 AS INT) AS is_volume_spike, CAST(coalesce(n_base >= 3 AND mr > mb + 2 * sb, false) AS INT) AS is_amount_jump FROM g""")
def merchant_spikes(spark, sf_dir):
    out = series.spike_detectors(purchases(spark, sf_dir), "merchant", "ts", "amount", 30, 60)
    return rounded(out.select("merchant", "n_recent", "n_base", "volume_ratio", "is_ghost", "is_volume_spike", "is_amount_jump"), "volume_ratio")


@query("""SELECT CAST(date AS VARCHAR) AS date, year(date) AS year, month(date) AS month, weekofyear(date) AS iso_week, CASE WHEN day(date) <= 15 THEN 'Q1' ELSE 'Q2' END AS fortnight, year(date) + CASE WHEN month(date) >= 11 THEN 1 ELSE 0 END AS fiscal_year
    FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date FROM orders)""")
def calendar_of_orders(spark, sf_dir):
    return days_as_text(series.calendar_dimension(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate"), "date")


_ALERT = _ROBUST + """, al AS (SELECT event_type, day AS ad FROM z WHERE z > 1.5),
    b AS (SELECT al.event_type, ad, CAST(e.d = ad AS INT) AS is_day, CAST(k % 5 AS VARCHAR) AS category FROM al JOIN e ON e.event_type = al.event_type AND e.d BETWEEN ad - 21 AND ad),
    c AS (SELECT event_type, ad, category, sum(is_day) AS nd, sum(1 - is_day) AS nb FROM b GROUP BY ALL)"""


def _alert_rows(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("five", F.col("k") % 5)
    scored = series.robust_z(series.densify(series.daily_series(own, ["event_type"], "ts", {"n": F.count(F.lit(1))}), ["event_type"], ["n"]), ["event_type"], "n")
    return attribution.with_baseline(scored.filter("z > 1.5"), own, ["event_type"], "ts")


@query(_ALERT + """, x AS (SELECT *, greatest(0.0, nd - nb / 21.0) AS excess FROM c WHERE nd > 0)
    SELECT event_type, CAST(ad AS VARCHAR) AS alert_day, category, nd AS n_day, nb AS n_base, round(excess, 4) AS excess, round(excess / nullif(sum(excess) OVER (PARTITION BY event_type, ad), 0), 4) AS share FROM x""")
def alert_share_of_excess(spark, sf_dir):
    out = attribution.share_of_excess(_alert_rows(spark, sf_dir), ["event_type"], ["five"])
    return days_as_text(rounded(out.select("event_type", "alert_day", "category", "n_day", "n_base", "excess", "share"), "excess", "share"), "alert_day")


@query(_ALERT + """, g AS (SELECT *, sum(nd) OVER w AS sd, sum(nb) OVER w AS sb, count(*) OVER w AS m FROM c WHERE nd + nb >= 5 WINDOW w AS (PARTITION BY event_type, ad)),
    h AS (SELECT *, (nd + nb) * sd / (sd + sb) AS ed, (nd + nb) * sb / (sd + sb) AS eb FROM g)
    SELECT event_type, CAST(ad AS VARCHAR) AS alert_day, round(sum((nd - ed) ** 2 / ed + (nb - eb) ** 2 / eb), 4) AS chi2, CAST(any_value(m) - 1 AS INT) AS dof FROM h WHERE m > 2 GROUP BY ALL""")
def alert_mix_shift(spark, sf_dir):
    out = attribution.mix_shift(_alert_rows(spark, sf_dir), ["event_type"], ["five"]).filter("dof > 1")
    return days_as_text(rounded(out.select("event_type", "alert_day", "chi2", "dof"), "chi2"), "alert_day")


@query(_ALERT + """, q AS (SELECT al.event_type, ad, CAST(e.d = ad AS INT) AS is_day, CASE WHEN k % 3 = 0 THEN 0.0 ELSE 1.0 END AS bad FROM al JOIN e ON e.event_type = al.event_type AND e.d BETWEEN ad - 21 AND ad)
    SELECT event_type, CAST(ad AS VARCHAR) AS alert_day, round(avg(bad) FILTER (is_day = 1), 4) AS rate_day, round(avg(bad) FILTER (is_day = 0), 4) AS rate_base,
    CAST(coalesce(avg(bad) FILTER (is_day = 1) > greatest(2 * avg(bad) FILTER (is_day = 0), avg(bad) FILTER (is_day = 0) + 0.15), false) AS INT) AS is_decline_jump FROM q GROUP BY ALL""")
def alert_decline_jump(spark, sf_dir):
    out = attribution.decline_jump(_alert_rows(spark, sf_dir), ["event_type"], F.col("k") % 3 == 0)
    return days_as_text(rounded(out, "rate_day", "rate_base"), "alert_day")


@query()
def attribution_report(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("five", F.col("k") % 5)
    scored = series.robust_z(series.densify(series.daily_series(own, ["event_type"], "ts", {"n": F.count(F.lit(1))}), ["event_type"], ["n"]), ["event_type"], "n")
    calendar = Calendar(holidays=("2024-01-01",), recurring=(("01-06", "kings"),), ranges=(("2024-01-20", "2024-01-25", "sale"),))
    return attribution.report(scored.filter("z > 1.5").select("event_type", "day", "n", "z"), own, ["event_type"], "ts", ["five", "k"], F.col("k") % 3 == 0, calendar)["alerts"]


@query(T + """, a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM t WHERE approved GROUP BY ALL), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM t WHERE NOT approved GROUP BY ALL),
    x AS (SELECT day, a.n AS a, b.n AS b FROM a JOIN b USING (day))
    SELECT CAST(day AS VARCHAR) AS day, a, b, a - b AS difference, round((a - b) / nullif(b, 0), 4) AS share, CAST(abs((a - b) / b) > 0.005 OR (a > b AND (a - b) / b > 0.001) AS INT) AS alert FROM x""")
def source_reconciliation(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumn("day", F.to_date("ts"))
    side = lambda c: own.filter(c).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days_as_text(rounded(stats.reconcile(side(F.col("approved")), side(~F.col("approved")), "day", "n"), "share"), "day")


@query(T + """, a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM t WHERE approved GROUP BY ALL), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM t WHERE NOT approved GROUP BY ALL)
    SELECT strftime(day, '%Y-%m') AS month, sum(a.n) AS a, sum(b.n) AS b, sum(a.n) - sum(b.n) AS difference, CASE WHEN sum(a.n) > sum(b.n) THEN 'a larger' WHEN sum(a.n) < sum(b.n) THEN 'b larger' ELSE 'equal' END AS relation
    FROM a JOIN b USING (day) GROUP BY 1""")
def monthly_reconciliation(spark, sf_dir):
    own = purchases(spark, sf_dir).withColumn("day", F.to_date("ts"))
    side = lambda c: own.filter(c).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return stats.monthly_pairs(stats.reconcile(side(F.col("approved")), side(~F.col("approved")), "day", "n"), "day")

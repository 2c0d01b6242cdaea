"""Queries that give each transaction features of its own, of earlier ones and of its groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, bands, calendar, labels, parsing, scores, text
from ..operators import cases, profiles, velocity
from ..sources.scratch import new_folder
from ..streaming import windows
from .registry import E, T, days_as_text, events, purchases, query, rounded, table

_EARLIER = "o.user_id = e.user_id AND (o.s < e.s OR (o.s = e.s AND o.event_id < e.event_id))"


@query(E + f"""SELECT e.event_id, count(o.event_id) FILTER (o.s >= e.s - 3600) AS n_1h, round(coalesce(sum(o.value) FILTER (o.s >= e.s - 3600), 0), 4) AS sum_1h,
    count(o.event_id) FILTER (o.s >= e.s - 86400) AS n_24h, round(coalesce(sum(o.value) FILTER (o.s >= e.s - 86400), 0), 4) AS sum_24h FROM e LEFT JOIN e o ON {_EARLIER} AND o.s >= e.s - 86400 GROUP BY e.event_id""")
def client_velocity(spark, sf_dir):
    out = velocity.velocity(events(spark, sf_dir), ["user_id"], "ts", "event_id", "value", {"1h": 3600, "24h": 86400})
    return rounded(out.select("event_id", "n_1h", "sum_1h", "n_24h", "sum_24h"), "sum_1h", "sum_24h")


@query(E + f"""SELECT e.event_id, count(o.event_id) FILTER (o.s >= e.s - 600) AS n_10m, round(coalesce(sum(o.value) FILTER (o.s >= e.s - 600), 0), 4) AS sum_10m,
    count(o.event_id) FILTER (o.s >= e.s - 86400) AS n_24h, round(coalesce(sum(o.value) FILTER (o.s >= e.s - 86400), 0), 4) AS sum_24h FROM e LEFT JOIN e o ON {_EARLIER} AND o.s >= e.s - 86400 GROUP BY e.event_id""")
def velocity_on_a_stream(spark, sf_dir):
    """Events in three files, read as a stream file by file; a fourth with one row in the far future moves the watermark past the last."""
    source, out, checkpoint = (new_folder(spark, n) for n in ("stream", "velocity", "checkpoint"))
    own = events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # estimated once: each of the three writes would estimate anew, and rows between two estimates be lost or read twice
    first, second = own.agg(F.percentile_approx(at, [1 / 3, 2 / 3])).first()[0] or (0, 0)
    placed = own.withColumn("file", F.when(at < first, 0).when(at < second, 1).otherwise(2))
    for k in range(3):
        placed.filter(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(source)
    last = own.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast(own.schema["user_id"].dataType).alias("user_id"), "ts", F.lit(-1).cast("bigint").alias("event_id"), F.lit(0.0).alias("value"))
    last.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = windows.exact_velocity_stream(stream, "user_id", "ts", "event_id", "value", {"10m": 600, "24h": 86400})
    found.writeStream.option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("user_id bigint, event_id bigint, n_10m bigint, sum_10m double, n_24h bigint, sum_24h double").parquet(out)
    return rounded(read.drop("user_id"), "sum_10m", "sum_24h")


@query(E + "SELECT e.event_id, count(o.event_id) AS n_earlier FROM e LEFT JOIN e o ON o.event_type = e.event_type AND (o.s < e.s OR (o.s = e.s AND o.event_id < e.event_id)) AND o.s >= e.s - 600 GROUP BY e.event_id")
def hot_key_velocity(spark, sf_dir):
    return velocity.bucketed_velocity(events(spark, sf_dir), ["event_type"], "ts", "event_id", 600).select("event_id", "n_earlier")


@query(E + """SELECT event_id, row_number() OVER w AS visit, CAST(row_number() OVER w = 1 AS INT) AS is_first, round((us - lag(us) OVER w) / 60e6, 4) AS gap_minutes, CAST(floor((us - lag(us) OVER w) / 86400e6) AS BIGINT) AS days_since_last
    FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def visit_sequence(spark, sf_dir):
    out = velocity.sequence_features(events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    return rounded(out.select("event_id", "visit", "is_first", "gap_minutes", "days_since_last"), "gap_minutes")


@query(E + """, x AS (SELECT *, row_number() OVER w AS visit, (us - lag(us) OVER w) / 60e6 AS gap, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, visit, CASE WHEN visit = 1 THEN 'first' WHEN gap <= 3 THEN 'short' ELSE 'long' END AS lapse_class, CASE WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'few' ELSE 'many' END AS count_class FROM x""")
def order_of_transactions(spark, sf_dir):
    return velocity.transaction_order(events(spark, sf_dir), ["user_id"], "ts", "event_id").select("event_id", "visit", "lapse_class", "count_class")


@query(E + """SELECT event_id, coalesce(sum(CAST(err AS INT)) OVER w, 0) AS prior_errors, round(avg(value) OVER w, 9) AS prior_mean, CAST(coalesce(value / nullif(avg(value) OVER w, 0) > 2, false) AS INT) AS is_jump,
    coalesce(lag(CAST(err AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS previous_flag FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_history(spark, sf_dir):
    out = velocity.prior_count(events(spark, sf_dir), F.col("err"), ["user_id"], "ts", "event_id", "prior_errors")
    out = velocity.previous_flag(velocity.prior_mean(out, "value", ["user_id"], "ts", "event_id"), F.col("err"), ["user_id"], "ts", "event_id")
    return rounded(out.select("event_id", "prior_errors", "prior_mean", "is_jump", "previous_flag"), "prior_mean", digits=9)


@query(E + f"""SELECT e.event_id, CAST(count(o.event_id) FILTER (o.err AND o.s >= e.s - 86400) > 0 AS INT) AS flag_in_last, round((e.us - max(o.us) FILTER (o.err AND o.us < e.us)) / 60e6, 4) AS minutes_since_last,
    round((e.us - max(o.us) FILTER (o.err AND o.us < e.us)) / 86400e6, 4) AS days_since_last FROM e LEFT JOIN e o ON {_EARLIER} GROUP BY e.event_id, e.us""")
def since_last_fraud(spark, sf_dir):
    out = velocity.flag_in_last(events(spark, sf_dir), F.col("err"), ["user_id"], "ts", "event_id")
    out = velocity.since_last(velocity.since_last(out, F.col("err"), ["user_id"], "ts"), F.col("err"), ["user_id"], "ts", 86400.0, "days_since_last")
    return rounded(out.select("event_id", "flag_in_last", "minutes_since_last", "days_since_last"), "minutes_since_last", "days_since_last")


@query(E + "SELECT e.event_id, count(o.event_id) AS denied_before FROM e LEFT JOIN e o ON o.user_id = e.user_id AND o.err AND o.us < e.us AND o.us >= e.us - 86400000000 GROUP BY e.event_id")
def denials_before(spark, sf_dir):
    return velocity.denied_before(events(spark, sf_dir), F.col("err"), ["user_id"], "ts").select("event_id", "denied_before")


@query(E + f"SELECT e.event_id, count(DISTINCT o.event_type) AS distinct_in_last FROM e LEFT JOIN e o ON {_EARLIER} AND o.s >= e.s - 86400 GROUP BY e.event_id")
def distinct_places_in_day(spark, sf_dir):
    return velocity.distinct_in_last(events(spark, sf_dir), "event_type", ["user_id"], "ts", "event_id").select("event_id", "distinct_in_last")


@query(E + """, g AS (SELECT user_id, d, count(*) AS n FROM e GROUP BY ALL) SELECT CASE WHEN n >= 4 THEN '4+' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS groups, count(DISTINCT user_id) AS keys FROM g GROUP BY 1""")
def day_buckets(spark, sf_dir):
    return velocity.day_bucket_counts(events(spark, sf_dir), "user_id", "ts", 4)


@query(E + """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, dayname(ts) AS weekday_name, month(ts) AS month, monthname(ts) AS month_name, year(ts) AS year, day(ts) AS day, weekofyear(ts) AS iso_week, CAST(isodow(ts) > 5 AS INT) AS is_weekend,
    CASE WHEN day(ts) <= 15 THEN 'Q1' ELSE 'Q2' END AS fortnight, quarter(ts) AS quarter, strftime(ts, '%Y-%m') AS year_month,
    CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 19 THEN 'afternoon' ELSE 'evening' END AS band,
    CAST(isodow(ts) < 6 AND hour(ts) BETWEEN 8 AND 17 AS INT) AS working, CAST(hour(ts) < 6 OR isodow(ts) > 5 AS INT) AS risk FROM e""")
def time_features(spark, sf_dir):
    ts = F.col("ts")
    return events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in calendar.time_features(ts).items()], calendar.hour_band(F.hour(ts)).alias("band"), calendar.working_hours(ts).alias("working"), calendar.risk_hours(ts).alias("risk"))


_CALENDAR = calendar.Calendar(holidays=("2024-01-01",), recurring=(("01-06", "kings"),), ranges=(("2024-01-12", "2024-01-16", "sale"),))


@query(E + """SELECT DISTINCT CAST(d AS VARCHAR) AS day, nullif(concat_ws(' + ', CASE WHEN strftime(d, '%m-%d') = '01-06' THEN 'kings' END, CASE WHEN d BETWEEN DATE '2024-01-12' AND DATE '2024-01-16' THEN 'sale' END,
    CASE WHEN day(d) IN (15, 30) THEN 'pay day' END, CASE WHEN d = DATE '2024-01-01' THEN 'holiday' END), '') AS event, CAST(d = DATE '2024-01-01' AS INT) AS is_holiday, CAST(day(d) IN (15, 30) AS INT) AS is_pay_day FROM e""")
def calendar_events(spark, sf_dir):
    days = events(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    flags = calendar.calendar_flags(F.col("day"), _CALENDAR)
    return days.select(F.col("day").cast("string").alias("day"), calendar.event_label(F.col("day"), _CALENDAR).alias("event"), flags["is_holiday"].alias("is_holiday"), flags["is_pay_day"].alias("is_pay_day"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity >= 50 AND l_quantity % 50 = 0 AS INT) AS is_round, CAST(l_extendedprice = floor(l_extendedprice) AS INT) AS is_integer, CAST(l_quantity < 20 AS INT) AS is_low,
    round(l_extendedprice / nullif(l_quantity, 0), 9) AS unit_price, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'small' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'middle' WHEN l_quantity > 30 AND l_quantity <= 50 THEN 'large' END AS size_band FROM lineitem""")
def amount_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, x = amounts.amount_flags(F.col("l_quantity")), amounts.amount_flags(F.col("l_extendedprice"))
    out = li.select("l_orderkey", "l_linenumber", q["is_round"].alias("is_round"), x["is_integer"].alias("is_integer"), q["is_low"].alias("is_low"), amounts.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"), bands.banded(F.col("l_quantity"), (0, 10, 30, 50), ("small", "middle", "large")).alias("size_band"))
    return rounded(out, "unit_price", digits=9)


@query("""SELECT p_partkey, CASE WHEN contains(upper(p_name), 'RING') OR contains(upper(p_name), 'BOLT') THEN 'hardware' WHEN contains(upper(p_name), 'WIDGET') THEN 'gadget' ELSE 'other' END AS class,
    CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'SMALL' THEN 'S' ELSE p_type END AS type_label, CAST(regexp_matches(p_name, '(?i)red|blue') AS INT) AS is_coloured, p_brand || '|' || p_type AS key, sha256(p_brand || '|' || p_type) AS row_hash FROM part""")
def part_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rules = [("hardware", ("ring", "bolt")), ("gadget", ("widget",))]
    return p.select("p_partkey", labels.classify_by_keywords(F.col("p_name"), rules).alias("class"), labels.label_map(F.col("p_type"), {"ECONOMY": "E", "SMALL": "S"}, keep=True).alias("type_label"), labels.keyword_flag(F.col("p_name"), "red|blue").alias("is_coloured"), labels.key_concat(F.col("p_brand"), F.col("p_type")).alias("key"), text.row_hash(["p_brand", "p_type"]).alias("row_hash"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'denied' END AS status, CAST(date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS BIGINT) AS age_days,
    year(o_orderdate) + CASE WHEN month(o_orderdate) >= 11 THEN 1 ELSE 0 END AS fiscal_year, CAST(ltrim(substr(o_orderpriority, 1, 1), '0') IN ('1', '2') AS INT) AS is_urgent FROM orders""")
def order_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", labels.approval_status(F.col("o_orderstatus"), ("F",)).alias("status"), calendar.days_between(F.col("o_orderdate"), F.lit("2001-08-01").cast("timestamp")).alias("age_days"), calendar.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"), labels.code_flag(F.substring("o_orderpriority", 1, 1), ("01", "2")).alias("is_urgent"))


@query("""SELECT o_orderkey, CAST(CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS VARCHAR) AS d1, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d2, round(o_totalprice, 2) AS amount,
    lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || rpad(o_orderstatus, 3, ' ') || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS line FROM orders""")
def parsed_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = text.fixed_width([text.Field(F.col("o_orderkey"), 9, "0", True), text.Field(F.col("o_orderstatus"), 3), text.Field(F.col("o_custkey"), 8, "0", True)])
    return o.select("o_orderkey", parsing.parse_date(F.date_format("o_orderdate", "dd/MM/yyyy")).cast("string").alias("d1"), parsing.parse_date(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0"))).cast("string").alias("d2"), F.round(parsing.parse_amount(F.format_number("o_totalprice", 2)), 2).alias("amount"), line.alias("line"))


@query(E + """, g AS (SELECT event_id, value, CAST(value >= 50 AS INT) AS a, CAST(k >= 50 AS INT) AS b, CAST(hour(ts) < 6 AS INT) AS c FROM e)
    SELECT event_id, a + b + c AS score, CASE WHEN a + b + c = 0 THEN 'none' WHEN a + b + c <= 2 THEN 'low' ELSE 'mid' END AS profile, 3.0 * a + 2.0 * b + 1.0 * c AS weighted, CAST(a = 1 AND c = 1 AS INT) AS large_at_night, CAST(value >= 50 AND value >= 20 AS INT) AS ge_50 FROM g""")
def composite_scores(spark, sf_dir):
    own = events(spark, sf_dir).withColumns({"a": (F.col("value") >= 50).cast("int"), "b": (F.col("k") >= 50).cast("int"), "c": (F.hour("ts") < 6).cast("int")})
    flags = scores.threshold_flags({"value": (20, 50)})
    return own.select("event_id", scores.composite_score(["a", "b", "c"]).alias("score"), scores.risk_profile(scores.composite_score(["a", "b", "c"])).alias("profile"), scores.weighted_score({"a": 3.0, "b": 2.0, "c": 1.0}).alias("weighted"), scores.interaction_flags({"x": (F.col("a"), F.col("c"))})["x"].alias("large_at_night"), flags["value_ge_50"].alias("ge_50"))


@query(T + """SELECT client, count(*) AS n, round(sum(amount), 2) AS total, count(DISTINCT merchant) AS merchants, count(DISTINCT CAST(ts AS DATE)) AS days, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 4) AS per_day,
    CAST(count(*) > 1 AS INT) AS is_repeated, CAST(count(*) / count(DISTINCT CAST(ts AS DATE)) >= 3 AS INT) AS is_burst FROM t GROUP BY client""")
def client_profile(spark, sf_dir):
    out = profiles.activity(purchases(spark, sf_dir), ["client"], "ts", "amount", "merchant")
    return rounded(out.select("client", "n", F.round("total", 2).alias("total"), "merchants", "days", "per_day", "is_repeated", "is_burst"), "per_day")


@query(T + """, g AS (SELECT merchant, count(*) AS n, sum(amount) AS total, avg(amount) AS mean, count(DISTINCT client) AS clients, count(DISTINCT CAST(ts AS DATE)) AS days, sum(CAST(fraud AS INT)) AS frauds FROM t GROUP BY merchant)
    SELECT merchant, n, round(mean, 4) AS mean, clients, days, frauds, round(frauds / n, 4) AS fraud_rate, row_number() OVER (ORDER BY n DESC, merchant) AS rank FROM g""")
def merchant_profile(spark, sf_dir):
    out = profiles.merchant_profile(purchases(spark, sf_dir), ["merchant"], "ts", "amount", "client", F.col("fraud"))
    return rounded(out.select("merchant", "n", "mean", "clients", "days", "frauds", "fraud_rate", "rank"), "mean", "fraud_rate")


@query(T + "SELECT merchant, count(DISTINCT client) AS cards, count(*) AS n FROM t GROUP BY merchant HAVING count(DISTINCT client) >= 400")
def mule_accounts(spark, sf_dir):
    return profiles.mule_accounts(purchases(spark, sf_dir), "merchant", "client", 400)


@query(T + """, g AS (SELECT merchant, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l, count(DISTINCT date_trunc('month', ts)) AS months, sum(amount) AS total FROM t GROUP BY merchant),
    c AS (SELECT quantile_cont(total, 0.8) AS cut, max(l) AS e FROM g)
    SELECT merchant, CAST(f AS VARCHAR) AS first_day, CAST(l AS VARCHAR) AS last_day, months, date_diff('day', f, l) AS age_days, CAST(date_diff('day', f, e) <= 30 AS INT) AS is_new, CAST(total >= cut AND date_diff('day', f, l) <= 30 AS INT) AS is_fast_impact FROM g, c""")
def merchant_novelty(spark, sf_dir):
    out = profiles.merchant_novelty(purchases(spark, sf_dir), "merchant", "ts", "amount")
    return days_as_text(out.select("merchant", "first_day", "last_day", "months", "age_days", "is_new", "is_fast_impact"), "first_day", "last_day")


@query(E + """, g AS (SELECT *, avg(value) OVER w AS m, coalesce(nullif(stddev_samp(value) OVER w, 0), 1) AS sd FROM e WINDOW w AS (PARTITION BY user_id))
    SELECT event_id, round((value - m) / sd, 9) AS z, round(value - m, 9) AS deviation, round(value / nullif(m, 0), 9) AS ratio, CAST(abs((value - m) / sd) > 3 AS INT) AS is_outlier FROM g""")
def client_zscore(spark, sf_dir):
    out = profiles.group_zscore(events(spark, sf_dir), ["user_id"], "value")
    return rounded(out.select("event_id", "z", "deviation", "ratio", "is_outlier"), "z", "deviation", "ratio", digits=9)


@query(E + """, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT user_id, event_type AS predominant FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
    SELECT event_id, predominant, CAST(event_type <> predominant AS INT) AS is_unusual FROM e JOIN m USING (user_id)""")
def predominant_merchant(spark, sf_dir):
    return profiles.predominant(events(spark, sf_dir), "event_type", ["user_id"]).select("event_id", "predominant", F.col("is_unusual_event_type").alias("is_unusual"))


@query(E + """, g AS (SELECT k, d, count(DISTINCT user_id) AS n FROM e GROUP BY ALL) SELECT event_id, n AS cards_same_day, CAST(n >= 2 AS INT) AS is_cards_same_day FROM e JOIN g USING (k, d)""")
def cards_of_range_and_day(spark, sf_dir):
    return profiles.distinct_per_day(events(spark, sf_dir), ["k"], "ts", "user_id", "cards_same_day").select("event_id", "cards_same_day", "is_cards_same_day")


@query(E + """, g AS (SELECT k, d, count(DISTINCT user_id) AS n FROM e GROUP BY ALL), v AS (SELECT e.event_id, count(o.event_id) FILTER (o.s >= e.s - 3600) AS n_1h, count(o.event_id) AS n_24h, round(coalesce(sum(o.value), 0), 4) AS sum_24h
    FROM e LEFT JOIN e o ON o.k = e.k AND (o.s < e.s OR (o.s = e.s AND o.event_id < e.event_id)) AND o.s >= e.s - 86400 GROUP BY e.event_id)
    SELECT event_id, n_1h, n_24h, sum_24h, n AS clients_day, CAST(n_1h >= 2 AS INT) AS is_burst, CAST(sum_24h >= 150 AS INT) AS is_large_amount, CAST(n >= 3 AS INT) AS is_many_clients FROM e JOIN v USING (event_id) JOIN g USING (k, d)""")
def bursts_of_ranges(spark, sf_dir):
    out = profiles.range_bursts(events(spark, sf_dir), "k", "ts", "event_id", "value", "user_id", 2, 150.0, 3)
    return rounded(out.select("event_id", "n_1h", "n_24h", "sum_24h", "clients_day", "is_burst", "is_large_amount", "is_many_clients"), "sum_24h")


@query(E + """, x AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 7 AS VARCHAR) END AS ex, k % 10 AS b FROM e), a AS (SELECT b, d, count(DISTINCT ex) AS expiries FROM x GROUP BY ALL), c AS (SELECT b, d, ex, count(DISTINCT user_id) AS n FROM x WHERE ex IS NOT NULL GROUP BY ALL)
    SELECT event_id, expiries, coalesce(n, 0) AS cards_same_expiry, CAST(coalesce(n, 0) >= 3 AS INT) AS is_expiry_concentrated FROM x JOIN a USING (b, d) LEFT JOIN c USING (b, d, ex)""")
def expiry_concentration(spark, sf_dir):
    own = events(spark, sf_dir).withColumns({"expiry": (F.col("k") % 7).cast("string"), "bin": F.col("k") % 10})
    return profiles.expiry_concentration(own, "bin", "ts", "expiry", "user_id").select("event_id", "expiries", "cards_same_expiry", "is_expiry_concentrated")


@query(E + """, x AS (SELECT *, floor(value / 10) * 10 AS a FROM e), g AS (SELECT event_type, d, stddev_samp(a) / nullif(avg(a), 0) AS cv, count(DISTINCT a) AS amounts FROM x GROUP BY ALL), c AS (SELECT event_type, d, a, count(DISTINCT user_id) AS n FROM x GROUP BY ALL)
    SELECT event_id, round(cv, 4) AS cv, amounts, n AS cards_same_amount, CAST(coalesce(n >= 3 AND cv < 0.9, false) AS INT) AS is_robotic FROM x JOIN g USING (event_type, d) JOIN c USING (event_type, d, a)""")
def robotic_amounts(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("a", F.floor(F.col("value") / 10) * 10.0)
    return rounded(profiles.robotic_amount(own, "event_type", "ts", "a", "user_id", 3, 0.9).select("event_id", "cv", "amounts", "cards_same_amount", "is_robotic"), "cv")


@query(E + """, g AS (SELECT event_type, avg(hour(ts)) AS m, greatest(coalesce(stddev_samp(hour(ts)), 2), 1) AS sd FROM e GROUP BY ALL) SELECT event_id, round(m, 4) AS hour_mean, round(sd, 4) AS hour_std, CAST(abs(hour(ts) - m) > sd AS INT) AS is_odd_hour FROM e JOIN g USING (event_type)""")
def usual_hours(spark, sf_dir):
    return rounded(profiles.hour_profile(events(spark, sf_dir), ["event_type"], "ts", 1.0).select("event_id", "hour_mean", "hour_std", "is_odd_hour"), "hour_mean", "hour_std")


@query(E + ", g AS (SELECT event_type, user_id, d, count(*) AS n FROM e GROUP BY ALL) SELECT event_type, round(avg(n), 6) AS mean_count FROM g GROUP BY event_type")
def mean_visits_of_client_day(spark, sf_dir):
    out = profiles.mean_of_counts(events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["event_type"], ["user_id", "day"])
    return out.withColumn("mean_count", F.round("mean_count", 6))


@query(E + f""", v AS (SELECT e.event_id, e.user_id, e.event_type, count(o.event_id) AS n_24h FROM e LEFT JOIN e o ON {_EARLIER} AND o.s >= e.s - 86400 GROUP BY ALL), g AS (SELECT event_type, user_id, d, count(*) AS n FROM e GROUP BY ALL),
    a AS (SELECT event_type, user_id, round(avg(n), 2) AS usual FROM g GROUP BY ALL), b AS (SELECT event_type, round(avg(n), 2) AS merchant_usual FROM g GROUP BY ALL)
    SELECT event_id, n_24h, usual, CAST(n_24h > 2 * usual AS INT) AS is_beyond_usual, merchant_usual, CAST(n_24h > 2 * merchant_usual AS INT) AS is_beyond_merchant_usual FROM v JOIN a USING (event_type, user_id) JOIN b USING (event_type)""")
def visits_beyond_usual(spark, sf_dir):
    own = velocity.velocity(events(spark, sf_dir), ["user_id"], "ts", "event_id", None, {"24h": 86400}).withColumn("day", F.to_date("ts"))
    out = profiles.beyond_mean_count(own, "n_24h", ["user_id", "event_type"], ["day"], name="usual")
    out = profiles.beyond_mean_count(out, "n_24h", ["event_type"], ["user_id", "day"], name="merchant_usual")
    return out.select("event_id", "n_24h", "usual", "is_beyond_usual", "merchant_usual", "is_beyond_merchant_usual")


@query(E + """, x AS (SELECT *, floor(value / 5) AS a FROM e), w AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, a) AS n_same, s - lag(s) OVER (PARTITION BY user_id, event_type, a ORDER BY ts, event_id) AS gap FROM x)
    SELECT event_id, n_same, CAST(coalesce(n_same >= 2 AND gap / 86400.0 < 7, false) AS INT) AS is_double FROM w""")
def double_charges(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("a", F.floor(F.col("value") / 5).cast("double"))
    return profiles.double_charge(own, ["user_id", "event_type"], "a", "ts", "event_id").select("event_id", "n_same", "is_double")


@query(E + """, g AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL) SELECT event_id, n AS frequency, CAST(event_type = 'purchase' AND n > 3 AS INT) AS is_unusual_frequency FROM e JOIN g USING (user_id, event_type)""")
def purchase_frequency(spark, sf_dir):
    return profiles.frequency(events(spark, sf_dir), ["user_id", "event_type"], F.col("event_type") == "purchase").select("event_id", "frequency", "is_unusual_frequency")


@query(E + """, x AS (SELECT *, (us - lag(us) OVER w) / 86400e6 AS gap, CAST(row_number() OVER w = 1 AS INT) AS first FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), c AS (SELECT quantile_cont(value, 0.9) AS cut FROM x)
    SELECT event_id, CAST(coalesce(gap < 20, false) AS INT) AS is_early, CAST(coalesce(gap > 45, false) AS INT) AS is_late, CAST(coalesce(gap * 1440 < 120, false) AS INT) AS is_rapid, CAST(coalesce(gap * 1440 BETWEEN 15 AND 120, false) AS INT) AS is_zone, CAST(first = 1 AND value >= cut AS INT) AS is_first_large FROM x, c""")
def recurring_gaps(spark, sf_dir):
    own = velocity.sequence_features(events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    return profiles.recurring_gap_flags(own, "gap_days", "value", "is_first").select("event_id", "is_early", "is_late", "is_rapid", "is_zone", "is_first_large")


@query("""WITH c AS (SELECT round(l_quantity, 2) AS price, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, price LIMIT 8), p AS (SELECT price, row_number() OVER (ORDER BY n DESC, price) AS place FROM c), b AS (SELECT max(price) FILTER (place = 1) AS base, max(price) FILTER (place = 2) AS second FROM p),
    x AS (SELECT l_linestatus = 'O' AS rec, round(l_quantity + 4 * l_discount, 2) AS x FROM lineitem),
    f AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE abs(x - price) <= CAST(0.01 AS DOUBLE) * (price + CAST(0.01 AS DOUBLE))) AS known, (SELECT max(m) FROM range(2, 13) r(m) WHERE abs(x - base * m) <= CAST(0.015 AS DOUBLE) * (base * m)) AS months,
    abs(x - second) <= CAST(0.015 AS DOUBLE) * (second + CAST(0.01 AS DOUBLE)) AS maintained FROM x, b),
    k AS (SELECT *, x > base * CAST(1.02 AS DOUBLE) AND x < base * 1.5 AND NOT known AND months IS NULL AS addon FROM f)
    SELECT CASE WHEN known THEN 'known_price' WHEN months IS NOT NULL THEN 'months_' || months WHEN addon THEN 'addon' WHEN maintained THEN 'maintenance' WHEN rec THEN 'unexplained' ELSE 'other' END AS charge_type, count(*) AS n,
    sum(CAST(known AS INT)) AS known_price, sum(CAST(months IS NOT NULL AS INT)) AS several_months, sum(CAST(addon AS INT)) AS addon, sum(CAST(maintained AS INT)) AS maintenance FROM k GROUP BY 1""")
def charge_types(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    own = li.withColumn("charge", F.bround(F.col("l_quantity") + 4 * F.col("l_discount"), 2))
    out = profiles.charge_types(own, "charge", profiles.price_catalogue(li, "l_quantity"), F.col("l_linestatus") == "O")
    return out.groupBy("charge_type").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"is_{c}").alias(c) for c in ("known_price", "several_months", "addon", "maintenance")])


@query("""WITH c AS (SELECT conv_id, turn, role FROM conversations), q AS (SELECT conv_id, min(turn) AS request_at FROM c WHERE role = 'user' GROUP BY conv_id),
    a AS (SELECT conv_id, min(turn) AS reply_at FROM c JOIN q USING (conv_id) WHERE role = 'assistant' AND turn > request_at GROUP BY conv_id)
    SELECT q.conv_id AS thread, request_at, reply_at, CASE WHEN reply_at IS NULL THEN 'pending' ELSE 'answered' END AS status FROM q LEFT JOIN a USING (conv_id)""")
def request_reply_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    out = cases.pair_request_reply(c, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", F.lit("user"), F.array(F.lit("user")))
    return out.select("thread", "request_at", "reply_at", "status")


@query("""SELECT conv_id, turn, upper(trim(role)) AS role, CASE WHEN contains(upper(text), 'THE') THEN 'the' WHEN contains(upper(text), 'DER') THEN 'der' END AS tool FROM conversations""")
def message_tools(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_text(F.col("role")).alias("role"), cases.tool_of(F.col("text"), ["the", "der"]).alias("tool"))


@query("""SELECT o_orderkey AS page_id, CAST(0 AS BIGINT) AS row, 'code' AS "column", o_orderstatus AS value FROM orders
    UNION ALL SELECT o_orderkey, 0, 'priority', o_orderpriority FROM orders""")
def html_tables(spark, sf_dir):
    cells = F.concat(F.lit("</p><table><tr><th>Code</th><th>Priority</th></tr><tr><td> "), F.col("o_orderstatus"), F.lit("<td>"), F.col("o_orderpriority"), F.lit("</tr></table>"))
    page = F.concat(F.lit("<p>Order "), F.col("o_orderkey").cast("string"), cells)
    return cases.html_table_rows(table(spark, sf_dir, "orders").select("o_orderkey", page.alias("html")), "o_orderkey", "html", "code")


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events) SELECT event_type, h AS hour, count(*) AS n FROM e GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    out = windows.window_counts(events(spark, sf_dir), ["event_type"], "ts", "1 hour")
    return out.select("event_type", F.floor(F.unix_timestamp(F.col("start").cast("timestamp")) / 3600).alias("hour"), "n")

"""Queries of readers, sinks, medallion tables, parsers and message cases. Files are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import amounts, calendar, labels, parsing, text, transfers
from ..operators import cases, models, profiles, series, stats, tables
from ..sources import medallion, readers, schema, versions
from ..sources.scratch import new_folder
from ..streaming import windows
from .registry import events, query, table


def _orders(spark, sf_dir, *columns):
    return table(spark, sf_dir, "orders").select(*columns)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, o_orderpriority AS priority, true AS has_file FROM orders")
def text_table(spark, sf_dir):
    path = new_folder(spark, "list")
    readers.write_list(_orders(spark, sf_dir, F.col("o_orderkey").alias(" key "), F.col("o_orderstatus").alias("status "), F.col("o_orderpriority").alias("priority")), path)
    return readers.read_text_table(spark, path).select("key", "status", "priority", F.col("source_file").startswith("part-").alias("has_file"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'Ñandú ' || c_name AS name, NULL AS nation FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR) FROM supplier")
def latin_pair(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("Ñandú "), F.col("c_name")).alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    paths = [new_folder(spark, "latin") for _ in range(2)]
    for df, path in zip((c, s), paths):
        df.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_pair(spark, *paths).select("key", "name", "nation")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def sniffed_table(spark, sf_dir):
    path = new_folder(spark, "sniffed")
    table(spark, sf_dir, "orders").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_text_table(spark, path, readers.sniff_separator(spark, path)).select("o_orderkey", "o_orderpriority")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2024_3' ELSE '2024_11' END AS folder, CASE WHEN o_orderkey % 2 = 0 THEN 202403 ELSE 202411 END AS period, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY ALL")
def period_folders(spark, sf_dir):
    root, own = new_folder(spark, "periods"), _orders(spark, sf_dir, "o_orderkey")
    for k, folder in enumerate(("2024_3", "2024_11")):
        readers.write_table(own.filter(F.col("o_orderkey") % 2 == k), f"{root}/{folder}")
    readers.write_table(own, f"{root}/other")
    return readers.read_period_folders(spark, root).groupBy("folder", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def files_not_read_yet(spark, sf_dir):
    root, own = new_folder(spark, "files"), _orders(spark, sf_dir, "o_orderkey", "o_orderstatus")
    readers.write_table(own.filter("o_orderstatus = 'F'"), f"{root}/first")
    manifest = new_folder(spark, "manifest")
    readers.write_table(readers.files_to_process(spark, root), manifest)
    readers.write_table(own.filter("o_orderstatus <> 'F'"), f"{root}/second")
    found = readers.files_to_process(spark, root, spark.read.parquet(manifest)).filter(F.col("path").endswith(".parquet")).select("path").collect()  # a row for each file
    return spark.read.schema(own.schema).parquet(*[r.path for r in found]).select("o_orderkey")


@query("SELECT o_orderkey AS key, TRY_CAST(o_orderpriority AS DOUBLE) AS priority, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS branch FROM orders")
def standardized_orders(spark, sf_dir):
    own = _orders(spark, sf_dir, F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), "o_custkey")
    return schema.standardize(own, StructType.fromDDL("key bigint, priority double, price double, branch string"))


@query("SELECT o_orderkey, 'debit' AS source, strftime(o_orderdate, '%Y%m') AS period FROM orders")
def tagged_orders(spark, sf_dir):
    own = _orders(spark, sf_dir, "o_orderkey", F.concat(F.lit("list_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv")).alias("file"))
    return schema.tag_source(own, "debit", "file").select("o_orderkey", "source", "period")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, CAST(NULL AS DOUBLE) AS o_orderstatus FROM orders")
def typed_columns(spark, sf_dir):
    own = schema.cast_numbers(_orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return own.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


_MIXED = """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '000' WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) END AS code, CAST(o_custkey AS VARCHAR) || '.5' AS rate, o_orderpriority AS priority, ' ' AS nothing FROM orders)"""


def _mixed(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 3 == 0, "000").when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), code.alias("code"), F.concat(F.col("o_custkey").cast("string"), F.lit(".5")).alias("rate"), F.col("o_orderpriority").alias("priority"), F.lit(" ").alias("nothing"))


@query(_MIXED + """ SELECT 'id' AS "column", count(*) AS n, count(*) AS n_integer, 0 AS n_number, 0 AS n_text, 'integer' AS kind FROM o UNION ALL SELECT 'code', count(code), count(code) FILTER (code <> '000'), 0, count(*) FILTER (code = '000'), 'mixed' FROM o
    UNION ALL SELECT 'rate', count(*), 0, count(*), 0, 'number' FROM o UNION ALL SELECT 'priority', count(*), 0, 0, count(*), 'text' FROM o UNION ALL SELECT 'nothing', 0, 0, 0, 0, 'empty'""")
def mixed_types(spark, sf_dir):
    return schema.type_mix(_mixed(spark, sf_dir))


@query(_MIXED + " SELECT o_orderkey, CAST(id AS BIGINT) + 1 AS id, code || '' AS code, CAST(rate AS DOUBLE) * 2 AS rate, priority FROM o")
def settled_types(spark, sf_dir):
    own = schema.settle_types(_mixed(spark, sf_dir))
    return own.select("o_orderkey", (F.col("id") + F.lit(1)).alias("id"), F.concat("code", F.lit("")).alias("code"), (F.col("rate") * 2).alias("rate"), "priority")


@query(_MIXED + """ SELECT 'ID' AS wanted, 'found' AS status, 'id' AS "column", NULL AS similar, count(id) AS n_filled FROM o UNION ALL SELECT 'Code', 'found', 'code', NULL, count(code) FROM o UNION ALL SELECT 'Nothing', 'found', 'nothing', NULL, 0
    UNION ALL SELECT 'order priority', 'missing', NULL, 'priority', NULL UNION ALL SELECT 'branch', 'missing', NULL, NULL, NULL""")
def column_report(spark, sf_dir):
    return readers.column_diagnostics(_mixed(spark, sf_dir), ["ID", "Code", "Nothing", "order priority", "branch"])


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 22:52:29' AS localized, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 0' || CAST(o_orderkey % 10 AS VARCHAR) || ':05:07' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS built FROM orders""")
def parsed_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(n) for n in ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "set", "oct", "nov", "dic")])
    local = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.concat(F.element_at(names, F.month("o_orderdate")), F.lit(".")), F.year("o_orderdate").cast("string"), F.lit("22:52:29"))
    clock = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("at "), (F.col("o_orderkey") % 10).cast("string"), F.lit(":05:07 h")))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", shown(parsing.parse_localized_timestamp(local)).alias("localized"), shown(parsing.timestamp_of(F.date_format("o_orderdate", "yyyyMMdd"), clock)).alias("built"))


@query("""WITH c AS (SELECT o_orderkey, '411111' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS card FROM orders)
    SELECT o_orderkey, card, substr(card, 1, 6) AS bin6, substr(card, 1, 10) AS bin10, substr(card, 1, 11) AS bin11, substr(card, 1, 12) AS bin12 FROM c""")
def rebuilt_cards(spark, sf_dir):
    first = F.concat(F.lit(" 411111******"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", text.rebuild_card(first, F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")).alias("card"))
    return own.withColumns(profiles.prefixes(F.col("card")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' AND (o_orderpriority IN ('3-MEDIUM') OR substr(o_orderpriority, 1, 1) IN ('1', '5'))")
def period_and_segment(spark, sf_dir):
    own = schema.filter_period(table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1998-06-30")
    return schema.filter_segment(own, "o_orderpriority", ["3-MEDIUM"], ["1", "5"]).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'settled' ELSE 'open' END AS entity, CASE WHEN o_custkey % 3 = 0 THEN 'unhandled' WHEN o_custkey % 3 = 1 THEN 'unhandled' ELSE 'handled' END AS management FROM orders")
def memberships(spark, sf_dir):
    analyst = F.when(F.col("o_custkey") % 3 == 1, " N.A. ").when(F.col("o_custkey") % 3 == 2, F.col("o_custkey").cast("string"))
    return _orders(spark, sf_dir, "o_orderkey", labels.classify_by_membership(F.col("o_orderstatus"), {"settled": ["F", "P"]}, "open").alias("entity"), labels.handled(analyst).alias("management"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 > 1")
def gold_vrm(spark, sf_dir):
    stip = F.when(F.col("o_custkey") % 4 == 0, "9212").when(F.col("o_custkey") % 4 == 1, "9224").otherwise("0000")
    return medallion.gold_without_stip(table(spark, sf_dir, "orders").withColumn("stip", stip), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def valid_declines(spark, sf_dir):
    own = table(spark, sf_dir, "orders").withColumns({
        "code": F.when(F.col("o_orderstatus") == "F", " 63").otherwise("05"),
        "condition": F.when(F.col("o_orderpriority") == "1-URGENT", "NM").when(F.col("o_orderpriority") == "5-LOW", "RD ").when(F.col("o_orderpriority") == "2-HIGH", "XX"),
    })
    return medallion.valid_declines(own, "code", "condition").select("o_orderkey")


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS custkey, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS day, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS status FROM orders")
def silver_of_two_days(spark, sf_dir):
    path, o = new_folder(spark, "silver"), table(spark, sf_dir, "orders")
    medallion.append_silver(spark, o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").cast("int").alias("custkey")), path, "2024-01-01")
    second = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").cast("double").alias("custkey"), F.col("o_orderstatus").alias("status"))
    for _ in range(2):  # a rerun leaves the same rows
        medallion.append_silver(spark, second, path, "2024-01-02")
    out = spark.read.option("mergeSchema", True).parquet(path)
    return out.select("o_orderkey", "custkey", F.col("load_date").cast("string").alias("day"), "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus <> 'P'")
def gold_of_history(spark, sf_dir):
    o, silver, gold = table(spark, sf_dir, "orders"), new_folder(spark, "silver"), new_folder(spark, "gold")
    parts = [o.filter("o_orderkey % 3 = 0").select("o_orderkey"), o.filter("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_orderstatus").alias("status"))]
    medallion.bootstrap(spark, parts, silver, gold, lambda df: df.filter("status IS NULL OR status <> 'P'").select("o_orderkey", "status"), "2024-01-01")
    return spark.read.parquet(gold)


@query("SELECT 'bad' AS tool, CAST(0 AS BIGINT) AS rows, 'error' AS status UNION ALL SELECT 'events', (SELECT count(*) FROM events), 'ok' UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 'ok'")
def daily_log(spark, sf_dir):
    log = new_folder(spark, "log")
    loads = {n: (lambda n=n: table(spark, sf_dir, n).count()) for n in ("orders", "events")}
    medallion.run_daily(spark, log, {"bad": lambda: int("no number"), **loads})
    return spark.read.parquet(log).select("tool", "rows", F.element_at(F.split("status", ":"), 1).alias("status"))


def _two_loads(spark, sf_dir):
    """Orders in two deliveries and a broken one: the second has rows as before, changed ones, new ones, some twice, some without a key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    found, log = versions.Versions(spark, new_folder(spark, "tables")), new_folder(spark, "log")
    gold = lambda df: df.filter("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("price").alias("amount"))
    second = o.filter("o_orderkey % 4 > 0").withColumn("price", F.when(F.col("o_orderkey") % 8 == 1, F.col("price") + 1).otherwise(F.col("price")))
    second = second.unionByName(second.filter("o_orderkey % 8 = 2")).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 8 != 3, F.col("o_orderkey"))).withColumn("note", F.lit(None).cast("string"))
    versions.logged_load(found, log, "first", lambda: versions.load(found, o.filter("o_orderkey % 4 < 3"), ["o_orderkey"], gold))
    versions.logged_load(found, log, "broken", lambda: versions.load(found, second, ["o_orderkey"], lambda df: df.select("no_such_column")))
    versions.logged_load(found, log, "second", lambda: versions.load(found, second, ["o_orderkey"], gold))
    return found, log


@query("""WITH s AS (SELECT o_orderkey % 8 AS k, o_orderkey % 4 AS m FROM orders)
    SELECT 'first' AS source, count(*) AS read, count(*) AS new, 0 AS updated, 0 AS skipped, 0 AS errors, 1 AS version, 'ok' AS status FROM s WHERE m < 3
    UNION ALL SELECT 'broken', 0, 0, 0, 0, 0, 1, 'error'
    UNION ALL SELECT 'second', count(*) + count(*) FILTER (k = 2), count(*) FILTER (k = 7), count(*) FILTER (k = 1), count(*) FILTER (k IN (2, 5, 6)) + count(*) FILTER (k = 2), count(*) FILTER (k = 3), 2, 'ok' FROM s WHERE m > 0""")
def load_counts(spark, sf_dir):
    _, log = _two_loads(spark, sf_dir)
    return spark.read.parquet(log).select("source", "read", "new", "updated", "skipped", "errors", "version", F.element_at(F.split("status", ":"), 1).alias("status"))


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice + CASE WHEN o_orderkey % 8 = 1 THEN 1 ELSE 0 END), 2) AS amount
    FROM orders WHERE o_orderkey % 8 <> 3 AND o_orderstatus <> 'P' GROUP BY o_orderstatus""")
def gold_after_two_loads(spark, sf_dir):
    found, _ = _two_loads(spark, sf_dir)
    return found.read("gold").withColumn("amount", F.round("amount", 2))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '2024-01-01' ELSE '2024-01-02' END AS day FROM orders")
def bronze_days(spark, sf_dir):
    path, own = new_folder(spark, "bronze"), _orders(spark, sf_dir, "o_orderkey", "o_orderstatus")
    for day, rows in (("2024-01-01", "o_orderstatus = 'F'"), ("2024-01-02", "true"), ("2024-01-02", "o_orderstatus <> 'F'")):
        medallion.archive(own.filter(rows), path, day)
    return spark.read.parquet(path).select("o_orderkey", F.col("load_date").cast("string").alias("day"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN 'YAPE_PLIN_QR' WHEN 1 THEN 'PASARELA' WHEN 2 THEN 'TRANSFERENCIA' WHEN 3 THEN 'PAGO' WHEN 4 THEN 'OTRO' ELSE 'OTRO' END AS operation,
    CASE k WHEN 0 THEN 'YAPE_PLIN' WHEN 1 THEN 'PASARELA' WHEN 2 THEN 'TRANSF_INMEDIATA' WHEN 5 THEN 'DESCONOCIDO' ELSE 'OTRO' END AS channel, CASE k WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' WHEN 2 THEN 'Web' ELSE 'OTRO' END AS device,
    CAST(k IN (3, 5) AS INT) AS no_authenticator, CAST(k = 0 AS INT) AS otp, CAST(k = 1 AS INT) AS biometric, CAST(k = 2 AS INT) AS digital_key FROM x""")
def transfer_classes(spark, sf_dir):
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    operation = pick("pago por Yape", "Pasarela", "Transf. inmediata", "pago de servicio", "retiro", None)
    device, means = pick("Apple", "android 14", "internet", "cajero", "", None), pick("otp sms", "biometria", "Clave digital", "no aplica", "token", None)
    return _orders(spark, sf_dir, "o_orderkey", transfers.classify_operation(operation).alias("operation"), transfers.classify_channel(operation).alias("channel"), transfers.device_type(device).alias("device"), *[c.alias(n) for n, c in transfers.authenticator_flags(means).items()])


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round_even(least(1.0, (o_custkey % 120) / CASE WHEN o_orderstatus = 'F' THEN 99.0 ELSE 999.0 END), 4) END AS s FROM orders)
    SELECT o_orderkey, s AS score_norm, CASE WHEN s <= 0.33 THEN 'low' WHEN s <= 0.66 THEN 'mid' WHEN s IS NOT NULL THEN 'high' END AS score_class, CAST(coalesce(s > 0.66, false) AS INT) AS score_risk FROM x""")
def brand_scores(spark, sf_dir):
    out = amounts.brand_score((F.col("o_custkey") % 120).cast("double"), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "P", "TD").otherwise("TC"), {"F": 99, "O": 999})
    return _orders(spark, sf_dir, "o_orderkey", *[c.alias(n) for n, c in out.items()])


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'local' ELSE 'other' END AS currency, CAST(o_custkey % 3 = 2 AS INT) AS is_unusual_currency, CAST(4 AS DOUBLE) AS exchange_rate FROM orders")
def inferred_currencies(spark, sf_dir):
    price, k = F.col("o_totalprice"), F.col("o_custkey") % 3
    original = F.when(k == 0, price * 1.01).when(k == 1, price * 4 * 0.99).otherwise(price * 2)
    out = amounts.currency_inference(price * 4, price, original, F.when(k == 0, "840").when(k == 1, " 604").otherwise("978"))
    return _orders(spark, sf_dir, "o_orderkey", *[c.alias(n) for n, c in out.items()])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'block' WHEN o_orderstatus = 'O' THEN 'review' END AS type, lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') AS client, CASE WHEN o_custkey % 2 = 0 THEN 'Ana ' || CAST(o_custkey AS VARCHAR) END AS name, CAST(o_custkey % 2 AS INT) AS is_reply,
    concat_ws('+', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'type' END, CASE WHEN o_custkey % 2 = 1 THEN 'name' END) AS missing FROM orders""")
def parsed_subjects(spark, sf_dir):
    client = F.lpad((F.col("o_orderkey") % 100000000).cast("string"), 8, "0")
    kind = F.when(F.col("o_orderstatus") == "F", "Bloqueo de tarjeta").when(F.col("o_orderstatus") == "O", "revisar caso").otherwise("Varios")
    subject = F.when(F.col("o_custkey") % 2 == 0, F.concat(kind, F.lit(" - "), client, F.lit(" - Ana "), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("RE: Fwd: "), kind, F.lit(" "), client))
    out = parsing.parse_subject(subject, {"block": ["bloqueo"], "review": ["revisar", "revision"]})
    return _orders(spark, sf_dir, "o_orderkey", *[c.alias(n) for n, c in out.items()]).withColumn("missing", F.concat_ws("+", "missing"))


@query("""SELECT o_orderkey, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE '-' END AS client, 'Agent ' || o_orderstatus AS signed_by, CAST(2 AS INT) AS n_lines, o_custkey % 1000 AS first_count, o_orderkey % 50 AS second_count FROM orders""")
def parsed_bodies(spark, sf_dir):
    number = lambda c: F.col(c).cast("string")
    client = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Client: "), number("o_custkey"))).otherwise("")
    counts = F.concat(F.lit("(A1) - first: "), (F.col("o_custkey") % 1000).cast("string"), F.lit("\n(B+) - second kind : "), (F.col("o_orderkey") % 50).cast("string"))
    body = F.concat_ws("\n", F.concat(F.lit("Priority: "), F.col("o_orderpriority")), client, counts, F.lit(""), F.concat(F.lit("Agent "), F.col("o_orderstatus")), F.lit("Senior Analyst"))
    fields = parsing.parse_labelled_body(body, {"priority": r"Priority:\s*(.+)", "client": r"Client:\s*(\d+)"})
    out = _orders(spark, sf_dir, "o_orderkey", *[c.alias(n) for n, c in fields.items()], parsing.signature_name(body, "analyst").alias("signed_by"), parsing.parse_count_lines(body).alias("lines"))
    return out.select("o_orderkey", "priority", "client", "signed_by", F.size("lines").alias("n_lines"), F.col("lines")[0]["n"].alias("first_count"), F.col("lines")[1]["n"].alias("second_count"))


@query("""WITH x AS (SELECT o_orderkey, CAST(floor(date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') / 86400.0) AS BIGINT) AS d, o_orderstatus = 'P' AS open FROM orders)
    SELECT o_orderkey, CASE WHEN NOT open AND d BETWEEN 0 AND 730 THEN d END AS claim_days, CASE WHEN NOT open AND d BETWEEN 0 AND 730 THEN round_even(d / 7.0, 1) END AS claim_weeks, CAST(open AS INT) AS no_claim_date FROM x""")
def claim_delays(spark, sf_dir):
    claim = F.when(F.col("o_orderstatus") != "P", F.lit("1998-01-01").cast("timestamp"))
    return _orders(spark, sf_dir, "o_orderkey", *[c.alias(n) for n, c in calendar.claim_delay(F.col("o_orderdate"), claim).items()])


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error' AND user_id % 50 = 7)")
def days_not_logged(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return windows.since_last(own, own.filter("event_type = 'error' AND user_id % 50 = 7"), "day").select("event_id")


@query("SELECT c_custkey AS key, 'stored' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def upserted_cases(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("stored").alias("origin"))
    return cases.insert_new(stored, _orders(spark, sf_dir, F.col("o_custkey").alias("key"), F.lit("new").alias("origin")), ["key"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'done' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'closed' END AS status FROM orders")
def approved_cases(spark, sf_dir):
    stored = _orders(spark, sf_dir, "o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("closed").alias("status"))
    return cases.approve_pending(stored, _orders(spark, sf_dir, "o_orderkey", "o_custkey").filter("o_custkey % 2 = 0").select("o_orderkey", F.lit("done").alias("status")), ["o_orderkey"])


@query("SELECT o_orderkey, concat_ws('+', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_custkey % 5 = 0 THEN 'client' END) AS missing FROM orders")
def incomplete_cases(spark, sf_dir):
    own = _orders(spark, sf_dir, "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("client"))
    complete, pending = cases.complete_and_pending(own, ["status", "client"])
    return complete.select("o_orderkey", F.lit("").alias("missing")).unionByName(pending.select("o_orderkey", F.concat_ws("+", "missing").alias("missing")))


@query("SELECT o_orderkey AS page_id, o_orderstatus AS code, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'none' END AS priority FROM orders")
def expanded_conditions(spark, sf_dir):
    line = F.concat(F.lit("<tr><td>"), F.col("o_orderstatus"), F.lit("</td><td>"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(""), F.lit("</td></tr>"))
    page = F.concat(F.lit("<table><tr><th>Code</th><th>Priority</th></tr>"), line, line, F.lit("<tr><td></td><td>lost</td></tr></table>"))
    rows = cases.html_table_rows(_orders(spark, sf_dir, "o_orderkey", page.alias("html")), "o_orderkey", "html", "code")
    return cases.expand_conditions(rows, {"priority": "none"}).select("page_id", "code", "priority")


@query("SELECT o_orderpriority AS code, count(*) AS n, false AS known FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), true FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def cases_by_code(spark, sf_dir):
    fine, unknown = cases.split_by_code(_orders(spark, sf_dir, F.col("o_orderpriority").alias("code")), "code", ["1-URGENT", "2-HIGH"])
    return fine.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query("""SELECT CASE WHEN value < 50 THEN '0-50' WHEN value < 100 THEN '50-100' ELSE '100+' END AS score_band, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (hour(ts) < 6) AS at_night FROM events WHERE value IS NOT NULL GROUP BY 1""")
def score_distribution(spark, sf_dir):
    band = F.when(F.col("value") < 50, "0-50").when(F.col("value") < 100, "50-100").otherwise("100+")
    own = events(spark, sf_dir).filter("value IS NOT NULL").withColumn("score_band", band)
    return stats.conditional_counts(own, ["score_band"], {"n": F.lit(True), "errors": F.col("err"), "at_night": F.hour("ts") < 6})


@query("SELECT hour(ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def hour_distribution(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    return stats.conditional_counts(own, ["hour"], {"n": F.lit(True), "errors": F.col("err"), "purchases": F.col("event_type") == "purchase"})


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE priority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, n DESC, priority LIMIT 3")
def priorities_in_order(spark, sf_dir):
    counts = _orders(spark, sf_dir, F.col("o_orderpriority").alias("priority")).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return tables.ordered_by_map(counts, "priority", {"3-MEDIUM": 0, "1-URGENT": 1}, [F.desc("n"), F.asc("priority")]).limit(3)


@query("""WITH b AS (SELECT max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + m AS number FROM orders, b WHERE o_orderstatus <> 'F'""")
def numbers_that_go_on(spark, sf_dir):
    own = _orders(spark, sf_dir, "o_orderkey", "o_orderdate", "o_orderstatus")
    out = tables.next_numbers(own.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), ["o_orderdate", "o_orderkey"], own.filter("o_orderstatus = 'F'"), "o_orderkey")
    return out.select("o_orderkey", "number")


@query("SELECT conv_id, turn, CASE WHEN contains(upper(text), 'THE') THEN '2 days' WHEN contains(upper(text), 'DER') THEN '1 week' ELSE 'ND' END AS estimate FROM conversations")
def tool_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cases.estimate_of(F.col("text"), {"the": "2 days", "der": "1 week"}).alias("estimate"))


@query("""WITH d AS (SELECT CAST(max(ts) AS DATE) AS l FROM events), x AS (SELECT sum(value) FILTER (CAST(ts AS DATE) >= date_trunc('month', l)) AS a, sum(value) FILTER (CAST(ts AS DATE) >= date_trunc('month', l - INTERVAL 1 MONTH) AND CAST(ts AS DATE) <= l - INTERVAL 1 MONTH) AS b FROM events, d)
    SELECT CAST(l AS VARCHAR) AS last_day, round(a, 2) AS month_to_date, round(b, 2) AS previous, round(a / b - 1, 6) AS change FROM x, d""")
def month_to_date(spark, sf_dir):
    out = tables.month_to_date(events(spark, sf_dir), "ts", F.sum("value"))
    return out.select(F.col("last_day").cast("string").alias("last_day"), F.round("month_to_date", 2).alias("month_to_date"), F.round("previous", 2).alias("previous"), F.round("change", 6).alias("change"))


@query("""WITH x AS (SELECT event_type = 'error' AS f, value > 100 AS large, hour(ts) < 6 AS night FROM events), y AS (SELECT 'large' AS flag, f FROM x WHERE large UNION ALL SELECT 'night', f FROM x WHERE night)
    SELECT flag, count(*) AS n, sum(CAST(f AS INT)) AS frauds, round(avg(CAST(f AS INT)), 6) AS rate, round(avg(CAST(f AS INT)) / (SELECT avg(CAST(f AS INT)) FROM x), 6) AS lift FROM y GROUP BY flag""")
def flag_lifts(spark, sf_dir):
    own = events(spark, sf_dir).withColumns({"large": (F.col("value") > 100).cast("int"), "night": (F.hour("ts") < 6).cast("int")})
    return tables.lift_of_flags(own, ["large", "night"], F.col("err")).withColumns({c: F.round(c, 6) for c in ("rate", "lift")})


@query("""WITH x AS (SELECT user_id % 97 AS bin, event_type = 'error' AS f, value = floor(value / 5) * 5 OR value > 150 AS r FROM events) SELECT bin, count(*) AS n, count(*) FILTER (r) AS flagged, count(*) FILTER (r AND f) AS frauds, round(count(*) FILTER (r) / count(*), 6) AS share,
    round(count(*) FILTER (r AND f) / count(*) FILTER (r), 6) AS rate FROM x GROUP BY bin HAVING count(*) FILTER (r) >= 2""")
def flagged_by_bin(spark, sf_dir):
    own = events(spark, sf_dir).withColumns({"bin": F.col("user_id") % 97, "flag": ((F.col("value") == F.floor(F.col("value") / 5) * 5) | (F.col("value") > 150)).cast("int")})
    return tables.flag_by_group(own, ["bin"], "flag", F.col("err"), 2).withColumns({c: F.round(c, 6) for c in ("share", "rate")})


@query("""WITH q AS (SELECT quantile_cont(value, 0.9) AS c FROM events) SELECT user_id, count(*) AS n, round(sum(value), 2) AS amount, count(*) FILTER (event_type = 'error') AS frauds FROM events, q WHERE value > c GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 20""")
def cards_of_top_decile(spark, sf_dir):
    return tables.top_decile_cards(events(spark, sf_dir), "user_id", "value", F.col("err")).withColumn("amount", F.round("amount", 2))


@query("""WITH v AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(min(ts) AS DATE) + CAST(user_id % 3 AS INT) AS b FROM events WHERE user_id < 5 GROUP BY user_id)
    SELECT event_id, string_agg(DISTINCT 'event ' || CAST(v.user_id AS VARCHAR), ' + ' ORDER BY 'event ' || CAST(v.user_id AS VARCHAR)) AS event FROM events LEFT JOIN v ON CAST(ts AS DATE) BETWEEN a AND b GROUP BY event_id""")
def events_of_days(spark, sf_dir):
    own = events(spark, sf_dir)
    first = own.filter("user_id < 5").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first"))
    calendar_table = first.select("first", F.date_add("first", (F.col("user_id") % 3).cast("int")).alias("last"), F.concat(F.lit("event "), F.col("user_id").cast("string")).alias("name"))
    return series.with_events(own, "ts", calendar_table).select("event_id", "event")


@query()
def tree_bands(spark, sf_dir):
    return models.tree_bands(events(spark, sf_dir).withColumn("label", (F.col("value") > 100).cast("int")), "value", "label")

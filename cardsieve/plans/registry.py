"""Registered queries and their SQL: operators of this package on the tables at hand.

``events`` stands for card transactions (user_id: client and card, event_type: merchant, k of props: category, value: amount,
error: fraud or denied), lineitem with orders for settled purchases (o_custkey: client, l_suppkey: merchant, R: fraud).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

E = """WITH e AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch_us(ts) AS us, CAST(ts AS DATE) AS d, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type = 'error' AS err FROM events)"""
T = """WITH t AS (SELECT o_custkey AS client, o_orderdate AS ts, l_extendedprice AS amount, l_suppkey AS merchant, l_partkey % 20 AS mcc, l_returnflag AS indicator,
       l_linestatus = 'F' AS approved, l_returnflag = 'R' AS fraud, l_quantity AS qty, l_discount AS discount, l_shipdate AS closed, o_orderpriority AS reason, o_custkey % 97 AS bin
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumns({"k": F.get_json_object("props", "$.k").try_cast("bigint"), "err": F.col("event_type") == "error"}).drop("props")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = li.join(o, li.l_orderkey == o.o_orderkey)
    return own.select(
        F.col("o_custkey").alias("client"), F.col("o_orderdate").alias("ts"), F.col("l_extendedprice").alias("amount"), F.col("l_suppkey").alias("merchant"), (F.col("l_partkey") % 20).alias("mcc"), F.col("l_returnflag").alias("indicator"),
        (F.col("l_linestatus") == "F").alias("approved"), (F.col("l_returnflag") == "R").alias("fraud"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_shipdate").alias("closed"), F.col("o_orderpriority").alias("reason"), (F.col("o_custkey") % 97).alias("bin"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def days_as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("date").cast("string") for n in names})


from . import queries_ingest, queries_models, queries_rules, queries_rows, queries_series, queries_tables  # noqa: E402, F401

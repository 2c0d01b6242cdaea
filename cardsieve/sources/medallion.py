"""Bronze, silver and gold tables, and the declines master."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import write_table
from .schema import align, drift_table

#: Codes that the gold tables and the master leave out or ask for.
VALID_DECLINE, CLOSED_CONDITIONS, STIP_CODES = "63", ("NM", "RD"), ("9212", "9224")
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def report_period(day: Column) -> dict[str, Column]:
    """day, yyyymm and two-digit day of month."""
    return {"report_day": day, "report_month": F.date_format(day, "yyyyMM"), "report_dd": F.lpad(F.dayofmonth(day).cast("string"), 2, "0")}


def archive(df: DataFrame, path: str, load_date: str) -> None:
    """Bronze: a raw copy by load date; a rerun of the day replaces it."""
    write_table(df.withColumn("load_date", F.lit(load_date).cast("date")), path, ["load_date"])


def without(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows whose code isn't one of these; rows without a code go too."""
    return df.filter(~F.col(column).isin(*codes))


def gold_debit(silver: DataFrame, columns: Sequence[str], bins: Sequence[str], mccs: Sequence[str], bin_: str = "bin6", mcc: str = "mcc", rule: str = "rule_code") -> DataFrame:
    """Chosen columns without excluded BINs and merchant categories and without rows that have no rule code; an empty list excludes nothing."""
    out = without(silver, bin_, bins) if bins else silver
    out = without(out, mcc, mccs) if mccs else out
    return out.filter(F.col(rule).isNotNull() & (F.trim(rule) != "")).select(*columns)


def gold_without_stip(silver: DataFrame, columns: Sequence[str], stip: str = "stip") -> DataFrame:
    return without(silver, stip, STIP_CODES).select(*columns)


def gold_by_result(silver: DataFrame, columns: Sequence[str], result: str, keep: Sequence[str]) -> DataFrame:
    return silver.filter(F.col(result).isin(*keep)).select(*columns)


def valid_declines(df: DataFrame, code: str, condition: str) -> DataFrame:
    """Declined by rule, and the condition isn't one of the closed ones (none at all is fine)."""
    c = F.trim(F.coalesce(F.col(condition).cast("string"), F.lit("")))
    return df.filter((F.trim(F.col(code).cast("string")) == VALID_DECLINE) & ~c.isin(*CLOSED_CONDITIONS))


def post_process(master: DataFrame, since: str, source_since: Mapping[str, str] = {}, default_entry: Mapping[str, str] = {}) -> DataFrame:
    """Global and per-source date cut, clean BIN and bin6, default entry mode of a source, composite key (null if a part is)."""
    out = master.filter(F.to_date("ts") >= F.lit(since).cast("date"))
    for source, first in source_since.items():
        out = out.filter((F.col("source") != source) | (F.to_date("ts") >= F.lit(first).cast("date")))
    clean = F.regexp_replace(F.trim(F.col("bin").cast("string")), r"\.0$", "")
    entry = F.col("entry_mode")
    for source, value in default_entry.items():
        entry = F.when((F.col("source") == source) & entry.isNull(), F.lit(value)).otherwise(entry)
    out = out.withColumns({"bin": clean, "entry_mode": entry}).withColumn("bin6", F.substring("bin", 1, 6))
    return out.withColumn("key", F.concat(F.col("source"), F.lit("|"), F.col("bin6"), F.lit("|"), F.date_format("ts", "yyyyMMdd")))


def load_summary(df: DataFrame, source: str, ts: str) -> DataFrame:
    """Rows, first and last day, share of missing dates of each source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.min(F.to_date(ts)).alias("first_day"), F.max(F.to_date(ts)).alias("last_day"), F.avg(F.col(ts).isNull().cast("double")).alias("null_share"))


def append_silver(spark: SparkSession, new: DataFrame, path: str, load_date: str, derived: Sequence[str] = ()) -> DataFrame | None:
    """Append a day's rows to silver by load date (a rerun replaces the day); returns the drift against what was stored.

    A column whose type has changed becomes double where both types are numbers, else text, in all that is stored.
    """
    from pyspark.errors import AnalysisException

    new = new.withColumn("load_date", F.lit(load_date).cast("date"))
    try:
        stored = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException:  # the first load
        write_table(new, path, ["load_date"])
        return None
    drift = drift_table(new, stored, [*derived, "load_date"])
    before, now = dict(stored.dtypes), dict(new.dtypes)
    wider = {c: "double" if {before[c], now[c]} <= _NUMBERS else "string" for c in now if c in before and before[c] != now[c]}
    if any(before[c] != kind for c, kind in wider.items()):  # what is stored takes the wider type, by way of a copy that stays as a backup
        backup = f"{path.rstrip('/')}_before_{load_date}"
        write_table(stored, backup, ["load_date"])
        stored = spark.read.schema(stored.schema).parquet(backup).withColumns({c: F.col(c).cast(kind) for c, kind in wider.items()})
        stored.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "static").partitionBy("load_date").parquet(path)
    new = new.withColumns({c: F.col(c).cast(kind) for c, kind in wider.items()})
    names = align(stored.limit(0), new)
    write_table(names, path, ["load_date"])
    return drift


def ingestion_log(spark: SparkSession, path: str, tool: str, source: str, load: Callable[[], int]) -> dict:
    """Run a load and append a line: run id, tool, source, rows, seconds, status. A failure is logged and told, not raised."""
    began, status, rows = time.time(), "ok", 0
    try:
        rows = load()
    except Exception as e:
        status = f"error: {type(e).__name__}: {str(e)[:200]}"
    entry = {"run_id": uuid.uuid4().hex, "tool": tool, "source": source, "rows": rows, "seconds": time.time() - began, "status": status}
    spark.createDataFrame([tuple(entry.values())], "run_id string, tool string, source string, rows bigint, seconds double, status string").coalesce(1).write.mode("append").parquet(path)
    return entry


def run_daily(spark: SparkSession, log: str, loads: Mapping[str, Callable[[], int]]) -> list[dict]:
    """Every load in turn; one that fails doesn't stop the others."""
    return [ingestion_log(spark, log, name, name, load) for name, load in loads.items()]


def bootstrap(spark: SparkSession, history: Sequence[DataFrame], silver: str, gold: str, to_gold: Callable[[DataFrame], DataFrame], load_date: str) -> None:
    """Silver from all history, gold from silver."""
    out = history[0]
    for df in history[1:]:
        out = align(out, df)
    write_table(out.withColumn("load_date", F.lit(load_date).cast("date")), silver, ["load_date"])
    write_table(to_gold(spark.read.parquet(silver)), gold)

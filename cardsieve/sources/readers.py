"""Reading and writing tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_name

SEPARATORS = (",", ";", "\t", "|")


def read_text_table(spark: SparkSession, paths: str | Sequence[str], separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited files as one table of text with the file of origin; trimmed column names, rows of nulls dropped."""
    df = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(list(paths) if not isinstance(paths, str) else paths)
    names = df.columns
    out = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in names], F.col("_metadata.file_name").alias("source_file"))
    return out.dropna("all", subset=[c.strip() for c in names])


def read_pair(spark: SparkSession, first: str, second: str, separator: str = ",") -> DataFrame:
    """Two lists of a day in Latin-1, united by name."""
    a, b = (read_text_table(spark, p, separator, "ISO-8859-1") for p in (first, second))
    return a.unionByName(b, allowMissingColumns=True)


def sniff_separator(spark: SparkSession, path: str, least: int = 6) -> str:
    """The first separator that cuts the header into at least ``least`` columns; the one with the most otherwise."""
    head = spark.read.text(path).limit(1).first()
    counts = {s: len((head[0] if head else "").split(s)) for s in SEPARATORS}
    return next((s for s in SEPARATORS if counts[s] >= least), max(counts, key=counts.get))


def read_period_folders(spark: SparkSession, root: str, pattern: str = r"\d{4}_\d{1,2}", file_format: str = "parquet") -> DataFrame:
    """Files below folders named like 2026_3, with the columns folder, period (yyyymm as a number) and source_file."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).format(file_format).load(root)
    out = df.withColumn("folder", F.regexp_extract("_metadata.file_path", rf"/({pattern})/", 1)).withColumn("source_file", F.col("_metadata.file_name"))
    year, month = (F.element_at(F.split("folder", "_"), k).try_cast("int") for k in (1, 2))
    return out.filter(F.col("folder") != "").withColumn("period", year * 100 + month)


def column_diagnostics(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Each wanted column: found or missing, for a missing one the columns that share a word with it, and for a found one the rows
    that hold a value (not null, not blank), counted in one pass."""
    have = {plain_name(c): c for c in df.columns}
    words = lambda n: set(re.findall(r"[a-z0-9]+", plain_name(n)))
    rows = [(w, "found" if plain_name(w) in have else "missing", have.get(plain_name(w)), None if plain_name(w) in have else ", ".join(sorted(c for c in df.columns if words(c) & words(w))) or None) for w in wanted]
    report = df.sparkSession.createDataFrame(rows, "wanted string, status string, column string, similar string")
    found = list(dict.fromkeys(r[2] for r in rows if r[2]))
    if not found:
        return report.withColumn("n_filled", F.lit(None).cast("bigint"))
    texts = [F.trim(F.col(f"`{c}`").cast("string")) for c in found]
    filled = df.agg(*[F.count(F.when(t != "", 1)).alias(f"c{k}") for k, t in enumerate(texts)])
    filled = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("n_filled")) for k, c in enumerate(found)])).alias("s")).select("s.*")
    return report.join(F.broadcast(filled), "column", "left").select("wanted", "status", "column", "similar", "n_filled")  # a row for each column


def find_header(spark: SparkSession, path: str, wanted: Sequence[str], separator: str = ",", most: int = 5) -> int:
    """How many lines to skip so that the header has the most wanted columns."""
    lines = [r[0] for r in spark.read.text(path).limit(most + 1).collect()]
    hits = [len({plain_name(c) for c in line.split(separator)} & {plain_name(w) for w in wanted}) for line in lines]
    return max(range(len(hits)), key=lambda k: (hits[k], -k)) if hits else 0


def files_to_process(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """Path, time and size of the files that are new or newer than in the manifest of processed ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    if done is None:
        return found
    seen = done.select("path", F.col("modificationTime").alias("__t"))
    return found.join(seen, "path", "left").filter(F.col("__t").isNull() | (F.col("modificationTime") > F.col("__t"))).drop("__t")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd; with partitions only those in the data are replaced, so a rerun leaves the same table."""
    df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic" if partition_by else "static").partitionBy(*partition_by).parquet(path)


def write_list(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_fixed_width(lines: DataFrame, path: str, chunk: str = "chunk", line: str = "line") -> None:
    """Text files, one folder for each chunk number."""
    lines.select(chunk, line).repartition(chunk).write.mode("overwrite").partitionBy(chunk).text(path)

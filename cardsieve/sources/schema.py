"""Schemas: drift, alignment, synonyms and a fixed master."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import plain_name


def schema_drift(new: StructType, stored: StructType, derived: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Column and status: added, missing or common; derived columns aside. A report: nothing stops."""
    a, b = set(new.fieldNames()) - set(derived), set(stored.fieldNames()) - set(derived)
    return sorted([(c, "added") for c in a - b] + [(c, "missing") for c in b - a] + [(c, "common") for c in a & b])


def drift_table(new: DataFrame, stored: DataFrame, derived: Sequence[str] = ()) -> DataFrame:
    return new.sparkSession.createDataFrame(schema_drift(new.schema, stored.schema, derived), "column string, status string")


def _widest(a, b):
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    x, y = a.simpleString(), b.simpleString()
    if x == y:
        return a
    return (a if order.index(x) >= order.index(y) else b) if x in order and y in order else None


def align(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables by name, absent columns as null. A column of two types takes the stored type if every value casts, else text.

    Numbers of different widths take the wider type.
    """
    left, right = {f.name: f.dataType for f in stored.schema}, {f.name: f.dataType for f in new.schema}
    clash = [c for c in left if c in right and left[c] != right[c]]
    lost = {c: F.count(F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(left[c]).isNull(), 1)).alias(c) for c in clash if _widest(left[c], right[c]) is None}
    bad = new.agg(*lost.values()).first().asDict() if lost else {}
    types = {c: _widest(left[c], right[c]) or (StringType() if bad[c] else left[c]) for c in clash}
    cast = lambda df: df.select(*[(F.col(c).cast("string").try_cast(types[c]) if c in types and df.schema[c].dataType != types[c] else F.col(c)).alias(c) for c in df.columns])
    return cast(stored).unionByName(cast(new), allowMissingColumns=True)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name with widening and nulls for absent columns."""
    out = frames[0]
    for df in frames[1:]:
        out = align(out, df)
    return out


def rename_by_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Canonical columns from source names; of several sources for one target the first there; absent targets are null text."""
    picked: dict[str, Column] = {}
    for source, target in names.items():
        if target not in picked and source in df.columns:
            picked[target] = F.col(source)
    rest = [F.col(c) for c in df.columns if c not in names]
    return df.select(*[picked.get(t, F.lit(None).cast("string")).alias(t) for t in dict.fromkeys(names.values())], *rest)


def resolve_synonyms(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Master columns, each from the first of its names that the table has (accents, case and spaces aside), else null."""
    have = {plain_name(c): c for c in reversed(df.columns)}
    pick = lambda names: next((F.col(f"`{have[plain_name(n)]}`") for n in names if plain_name(n) in have), F.lit(None).cast("string"))
    return df.select(*[pick([target, *names]).alias(target) for target, names in synonyms.items()])


def standardize(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the master's columns and types; what is missing or can't be cast is null."""
    return df.select(*[(F.col(f.name).cast("string").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def cast_numbers(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """The listed columns as doubles, all others as text."""
    return df.select(*[(F.col(c).cast("string").try_cast("double") if c in numeric else F.col(c).cast("string")).alias(c) for c in df.columns])


_INTEGER = r"^[+-]?(0|[1-9][0-9]{0,17})$"
_NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def type_mix(df: DataFrame) -> DataFrame:
    """What the values of each text column look like: column, n, n_integer, n_number, n_text and kind (integer, number, text, mixed,
    empty), counted in one pass. A code with leading zeros is text; nulls and blanks don't count.

    A column that holds both numbers and text is mixed. A row for each column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n bigint, n_integer bigint, n_number bigint, n_text bigint, kind string")
    long = df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in names]).unpivot([], [F.col(f"`{c}`") for c in names], "column", "value")
    v = F.nullif(F.col("value"), F.lit(""))
    whole, number = v.rlike(_INTEGER), v.rlike(_NUMBER)
    counts = long.groupBy("column").agg(F.count(v).alias("n"), F.count(F.when(whole, 1)).alias("n_integer"), F.count(F.when(number & ~whole, 1)).alias("n_number"), F.count(F.when(~number, 1)).alias("n_text"))
    numbers = F.col("n_integer") + F.col("n_number")
    kind = F.when(F.col("n") == 0, "empty").when(F.col("n_text") == F.col("n"), "text").when(F.col("n_text") > 0, "mixed").when(F.col("n_integer") == F.col("n"), "integer").when(numbers == F.col("n"), "number")
    return counts.withColumn("kind", kind)


def settle_types(df: DataFrame, mix: DataFrame | None = None) -> DataFrame:
    """Text columns of whole numbers as bigint, of numbers as double; those with mixed types, and all others, as they are."""
    kinds = {r["column"]: r["kind"] for r in (type_mix(df) if mix is None else mix).select("column", "kind").collect()}  # a row for each column
    to = {"integer": "bigint", "number": "double"}
    return df.select(*[F.trim(F.col(f"`{c}`")).try_cast(to[kinds[c]]).alias(c) if kinds.get(c) in to else F.col(f"`{c}`") for c in df.columns])


def filter_period(df: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows whose day lies from ``first`` to ``last`` (ISO dates, both inside; None: open). A null day is in no period."""
    x = F.to_date(F.col(day))
    keep = x.isNotNull()
    for bound, inside in ((first, lambda b: x >= b), (last, lambda b: x <= b)):
        keep = keep & inside(F.lit(bound).cast("date")) if bound else keep
    return df.filter(keep)


def filter_segment(df: DataFrame, column: str, members: Sequence[str] = (), letters: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is one of the members, or begins with one of the letters. Null is in no segment."""
    x = F.col(column).cast("string")
    return df.filter(F.coalesce(x.isin(list(members)) | F.substring(x, 1, 1).isin(list(letters)), F.lit(False)))


def tag_source(df: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Provenance: source, and the six digits of the file name as period."""
    out = df.withColumn("source", F.lit(name))
    return out.withColumn("period", F.nullif(F.regexp_extract(file, r"(\d{6})", 1), F.lit(""))) if file else out


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) by the order."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__k = 1").drop("__k")

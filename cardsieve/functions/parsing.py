"""Values out of text. What can't be read is null, never an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish month abbreviations.
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12}
_EMPTY = ("", "0", "none", "null", "nan", "nat")


def parse_date(x: Column) -> Column:
    """d/m/Y, Y/m/d, ISO or yyyymmdd, with an optional trailing .0; sentinels and anything else are null."""
    text = F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")
    text = F.when(~F.lower(text).isin(*_EMPTY), text)
    at = lambda pattern, form: F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(form)).cast("date"))
    return F.coalesce(at(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), at(r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), at(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), at(r"^\d{8}$", "yyyyMMdd"))


def parse_localized_timestamp(x: Column) -> Column:
    """'31 mar. 2026 22:52:29' with Spanish month names."""
    part = lambda k: F.regexp_extract(F.lower(F.trim(x)), r"^(\d{1,2})\s+([a-z]+)\.?\s+(\d{4})(?:\s+(\d{1,2}:\d{2}:\d{2}))?$", k)
    month = F.try_element_at(F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv]), F.substring(part(2), 1, 3))
    text = F.concat_ws(" ", F.concat_ws("-", part(3), month.cast("string"), part(1)), F.when(part(4) == "", "00:00:00").otherwise(part(4)))
    return F.when(month.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-M-d H:mm:ss")))


def timestamp_of(date: Column, time: Column, form: str = "yyyyMMdd") -> Column:
    """Date text and the first h:m:s found in the time text; midnight without one."""
    found = F.regexp_extract(F.coalesce(time.cast("string"), F.lit("")), r"(\d{1,2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.concat_ws(" ", F.trim(date.cast("string")), F.when(found == "", "0:00:00").otherwise(found)), F.lit(f"{form} H:mm:ss"))


def parse_amount(x: Column, decimal: str = ".") -> Column:
    """Number without thousands separators; with decimal="," the comma is the point."""
    text = F.trim(x.cast("string"))
    text = F.regexp_replace(text, ",", "") if decimal == "." else F.translate(F.regexp_replace(text, r"\.", ""), ",", ".")
    return text.try_cast("double")


def parse_subject(subject: Column, types: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Parts of 'type - client id - name', reply marks aside; the type by its variants, the id by 8 digits anywhere if need be."""
    bare = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^(\s*(re|fw|fwd|rv)\s*:\s*)+", ""))
    parts = F.split(bare, r"\s*-\s*", 3)
    upper = F.upper(bare)
    kind = F.lit(None).cast("string")
    for label, words in reversed(list(types.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(upper, F.lit(w.upper()))
        kind = F.when(hit, F.lit(label)).otherwise(kind)
    second = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    client = F.nullif(F.when(second.rlike(r"^\d{8}$"), second).otherwise(F.regexp_extract(bare, r"(?<!\d)(\d{8})(?!\d)", 1)), F.lit(""))
    name = F.nullif(F.trim(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))), F.lit(""))
    missing = F.array_compact(F.array(F.when(kind.isNull(), "type"), F.when(client.isNull(), "client"), F.when(name.isNull(), "name")))
    return {"type": kind, "client": client, "name": name, "is_reply": F.coalesce(subject.rlike(r"(?i)^\s*(re|fw|fwd|rv)\s*:"), F.lit(False)).cast("int"), "missing": missing}


def parse_labelled_body(body: Column, labels: Mapping[str, str], default: str = "-") -> dict[str, Column]:
    """The first group of each pattern; ``default`` where it isn't found."""
    return {n: F.coalesce(F.nullif(F.trim(F.regexp_extract(body, p, 1)), F.lit("")), F.lit(default)) for n, p in labels.items()}


def parse_count_lines(body: Column) -> Column:
    """All '(CODE) - description : n' of a text as an array of (code, description, n)."""
    pattern = r"\(([A-Z0-9+]+)\)\s*-\s*([^:\n]*?)\s*:\s*(\d+)"
    get = lambda k: F.regexp_extract_all(body, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("c")), lambda x: F.struct(x["a"].alias("code"), x["b"].alias("description"), x["c"].try_cast("bigint").alias("n")))


def signature_name(body: Column, role: str) -> Column:
    """The line before the first line that has the role; empty lines don't count."""
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(role.lower()))), F.lit(True))
    return F.when(at > 1, F.try_element_at(lines, (at - 1).cast("int")))

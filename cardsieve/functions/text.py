"""Text clean-up, hashes and fixed-width records."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and their plain forms, place by place.
ACCENTED, PLAIN = "áéíóúàèìòùäëïöüâêîôûñçÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛÑÇ", "aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC"


def plain_name(name: str) -> str:
    """Lower case without accents, white space collapsed."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", flat).strip().lower()


def normalize_names(df: DataFrame) -> DataFrame:
    """Columns under their plain names; a second column of one plain name gets a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = plain_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def normalize_value(x: Column) -> Column:
    """The same for values."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"\s+", " "))


def normalize_text(x: Column) -> Column:
    """Trimmed upper-case text without spreadsheet marks (=, quotes) and a trailing .0; empty becomes null."""
    out = F.regexp_replace(F.trim(x.cast("string")), "[=\"']", "")
    return F.nullif(F.upper(F.trim(F.regexp_replace(out, r"\.0$", ""))), F.lit(""))


def row_hash(columns: Sequence[str], separator: str = "|") -> Column:
    """SHA-256 of the columns as text; null counts as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


@dataclass(frozen=True)
class Field:
    """A field of a fixed-width record: cut or padded to its width, on the left for numbers."""

    value: Column
    width: int
    fill: str = " "
    left: bool = False


def fixed_width(fields: Sequence[Field]) -> Column:
    """One line of fixed-width fields."""
    parts = []
    for f in fields:
        text = F.coalesce(f.value.cast("string"), F.lit(""))
        parts.append(F.lpad(text, f.width, f.fill) if f.left else F.rpad(text, f.width, f.fill))
    return F.concat(*parts)


def rebuild_card(first: Column, middle: Column) -> Column:
    """A card number from two columns: six characters of the first, all of the second, the first from the thirteenth on.

    Blanks at the ends go; a null part, or one that says ``nan``, counts as empty; null where both are.
    """
    a, b = (F.coalesce(F.replace(F.trim(c.cast("string")), F.lit("nan"), F.lit("")), F.lit("")) for c in (first, middle))
    whole = F.concat(F.substring(a, 1, 6), b, F.substring(a, 13, 1 << 20))
    return F.when(whole != "", whole)

"""Labels and flags from codes and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def approval_status(code: Column, approved: Sequence[str] = ("0", "00", "000")) -> Column:
    return F.when(F.trim(code.cast("string")).isin(*approved), "approved").otherwise("denied")


def label_map(x: Column, labels: Mapping[str, str], default: str | None = None, keep: bool = False) -> Column:
    """Label of a code; otherwise the code itself (keep) or ``default``. Long lists belong in a table and a join."""
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.trim(x.cast("string"))), x.cast("string") if keep else F.lit(default))


def code_flag(x: Column, codes: Sequence[str], strip_zeros: bool = True) -> Column:
    """1 if the trimmed code, without leading zeros, is one of the codes (also taken without them)."""
    own, codes = F.trim(x.cast("string")), [c.lstrip("0") if strip_zeros else c for c in codes]
    return _flag((F.ltrim(own, F.lit("0")) if strip_zeros else own).isin(*codes))


def classify_by_keywords(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """Class of the first rule that has a keyword in the text, case aside; ``default`` for none and for null."""
    upper, out = F.upper(text), F.lit(default)
    for label, words in reversed(rules):
        hit = F.contains(upper, F.lit(words[0].upper()))
        for w in words[1:]:
            hit = hit | F.contains(upper, F.lit(w.upper()))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def keyword_flag(text: Column, pattern: str) -> Column:
    return _flag(text.rlike(f"(?i){pattern}"))


def key_concat(*parts: Column, separator: str = "|", null_if_any: bool = False) -> Column:
    """Composite key. null_if_any: null as soon as one part is; else nulls count as empty."""
    texts = [p.cast("string") for p in parts]
    if null_if_any:
        return F.concat(*[t for k, p in enumerate(texts) for t in ([F.lit(separator), p] if k else [p])])
    return F.concat_ws(separator, *[F.coalesce(t, F.lit("")) for t in texts])


def classify_by_membership(x: Column, classes: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """Class of the first list that holds the trimmed code; ``default`` for none and for null."""
    own, out = F.trim(x.cast("string")), F.lit(default)
    for label, codes in reversed(list(classes.items())):
        out = F.when(own.isin(*codes), F.lit(label)).otherwise(out)
    return out


def handled(analyst: Column, yes: str = "handled", no: str = "unhandled", empty: Sequence[str] = ("", "n.a.", "na", "nan")) -> Column:
    """Whether a case names an analyst; marks for nobody count as none."""
    own = F.lower(F.trim(analyst.cast("string")))
    return F.when(F.coalesce(~own.isin(*empty), F.lit(False)), yes).otherwise(no)

"""Binning by fixed edges and by quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bin(x: Column, edges: Sequence[float], closed: str) -> list[Column]:
    if closed not in ("left", "right"):
        raise ValueError("closed is left or right")
    pairs = zip(edges, edges[1:])
    return [(x > a) & (x <= b) if closed == "right" else (x >= a) & (x < b) for a, b in pairs]


def banded(x: Column, edges: Sequence[float], labels: Sequence[str], closed: str = "right") -> Column:
    """The label of the interval that holds x; null outside all of them and for null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label for each interval")
    out = F.lit(None).cast("string")
    for inside, label in reversed(list(zip(_bin(x, edges, closed), labels))):
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def band_order(x: Column, edges: Sequence[float], closed: str = "right") -> Column:
    """The number of the interval that holds x, from 0; for sorting by band."""
    out = F.lit(None).cast("int")
    for k, inside in reversed(list(enumerate(_bin(x, edges, closed)))):
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


def quantile_bucket(x: Column, edges: Column) -> Column:
    """Bucket from 1, right-closed, given all quantile edges as an array: equal edges count once, the lowest edge is inside."""
    own = F.array_distinct(edges)
    inner = F.slice(own, 2, F.greatest(F.size(own) - 2, F.lit(0)))
    return F.when(x.isNotNull(), 1 + F.size(F.filter(inner, lambda e: e < x))).cast("int")


def percentile_class(x: Column, cuts: Sequence[Column], labels: Sequence[str]) -> Column:
    """The first label whose cut is not below x, the last label beyond all cuts; null for null."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cuts")
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        out = F.when(x <= cut, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)

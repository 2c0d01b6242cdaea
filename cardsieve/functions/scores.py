"""Scores made of flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import banded

#: The two presets of edges for the number of active flags.
PROFILE_WIDE, PROFILE_NARROW = (-1, 0, 2, 5, 99), (-1, 0, 1, 2, 99)


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def weighted_score(weights: Mapping[str, float], anomaly: Column | None = None, anomaly_weight: float = 4.0) -> Column:
    """Sum of flags times weights, plus the rounded share of an anomaly score from 0 to 1."""
    out = _add([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()])
    return out if anomaly is None else out + F.bround(anomaly_weight * F.coalesce(anomaly, F.lit(0.0)))


def composite_score(flags: Sequence[str]) -> Column:
    """How many of the flags are on."""
    return _add([F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags])


def risk_profile(score: Column, edges: Sequence[int] = PROFILE_WIDE, labels: Sequence[str] = ("none", "low", "mid", "high")) -> Column:
    return banded(score, edges, labels)


def threshold_flags(thresholds: Mapping[str, Sequence[float]], pairs: Sequence[tuple[str, str]] = ()) -> dict[str, Column]:
    """A flag <column>_ge_<t> for each threshold, and for each pair of columns the flags of both at each pair of thresholds."""
    on = lambda c, t: F.coalesce(F.col(c) >= t, F.lit(False))
    name = lambda t: f"{t:g}".replace(".", "_")
    out = {f"{c}_ge_{name(t)}": on(c, t).cast("int") for c, ts in thresholds.items() for t in ts}
    for a, b in pairs:
        for s in thresholds[a]:
            for t in thresholds[b]:
                out[f"{a}_ge_{name(s)}_{b}_ge_{name(t)}"] = (on(a, s) & on(b, t)).cast("int")
    return out


def interaction_flags(pairs: Mapping[str, Sequence[Column]]) -> dict[str, Column]:
    """1 where all conditions of a name hold; unknown counts as no."""
    return {n: reduce(lambda a, b: a & b, [F.coalesce(c.cast("boolean"), F.lit(False)) for c in cs]).cast("int") for n, cs in pairs.items()}

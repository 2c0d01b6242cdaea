"""Amounts, ratios and scores given by others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def robust_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column, at_least: float | None = None) -> Column | tuple[Column, Column]:
    """a / b, null where b is 0; with ``at_least`` also the flag that the ratio reaches it."""
    r = robust_divide(a, b)
    return r if at_least is None else (r, _flag(r >= at_least))


def amount_flags(amount: Column, round_to: int = 50, low: float = 20.0, micro: float = 5.0) -> dict[str, Column]:
    return {
        "is_round": _flag((amount >= round_to) & (amount % round_to == 0)),
        "is_integer": _flag(amount == F.floor(amount)),
        "is_low": _flag(amount < low),
        "is_micro": _flag((amount > 0) & (amount <= micro)),
    }


def brand_score(score: Column, brand: Column, product: Column, scales: dict[str, float], credit: str = "TC", low_is_risk: bool = False, cuts: tuple[float, float] = (0.33, 0.66)) -> dict[str, Column]:
    """Score by its brand's scale, clipped to 0..1 and rounded, for credit only; class and risk flag by the chosen polarity."""
    scale = F.lit(None).cast("double")
    for name, top in scales.items():
        scale = F.when(brand == name, F.lit(float(top))).otherwise(scale)
    norm = F.when(product == credit, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / scale)), 4))
    level = F.when(norm <= cuts[0], "low").when(norm <= cuts[1], "mid").when(norm.isNotNull(), "high")
    return {"score_norm": norm, "score_class": level, "score_risk": _flag(level == ("low" if low_is_risk else "high"))}


def currency_inference(amount: Column, usd: Column, original: Column, code: Column, local_codes: tuple[str, ...] = ("604",), usd_codes: tuple[str, ...] = ("840",), tolerance: float = 0.01, low: float = 0.98, high: float = 1.02) -> dict[str, Column]:
    """Which currency the original amount is in: near the dollar amount or near the local one (absolute or by ratio)."""
    near = lambda a, b: F.coalesce((F.abs(a - b) <= tolerance) | robust_divide(a, b).between(low, high), F.lit(False))
    inferred = F.when(near(original, usd), "usd").when(near(original, amount), "local").when(original.isNotNull(), "other")
    return {"currency": inferred, "is_unusual_currency": _flag(~F.trim(code).isin(*local_codes, *usd_codes)), "exchange_rate": robust_divide(amount, usd)}


#: Amounts that are multiples of 1 / UNITS are added up as whole numbers.
UNITS = 10_000


def exact_parts(x: Column) -> tuple[Column, Column]:
    """An amount as a whole number of 1 / UNITS, and the amounts that are none; the other is null. Sums of the first are exact in any order."""
    v = x.cast("double")
    k = F.rint(v * UNITS)
    whole = (F.abs(v) < 1e11) & (k / UNITS == v)
    return F.when(whole, k.cast("bigint")).cast("decimal(19,0)"), F.when(~whole, v)


def exact_mean(units: Column, rest: Column, n: Column) -> Column:
    """The mean from the sums of both parts: of whole units it is the double next to the true mean, so that halves round alike everywhere."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    return F.coalesce(units.cast("double"), F.lit(0.0)) / (n * UNITS) + F.coalesce(rest, F.lit(0.0)) / n

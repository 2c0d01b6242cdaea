"""Dates and hours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("night", "morning", "afternoon", "evening")
DEFAULT_EDGES, EARLY_EDGES = (0, 6, 12, 19, 24), (0, 6, 12, 18, 24)


def time_features(ts: Column) -> dict[str, Column]:
    """Calendar parts of a timestamp by name; weekday counts from Monday = 0, fortnight is Q1 up to the 15th."""
    return {
        "hour": F.hour(ts), "weekday": F.weekday(ts), "weekday_name": F.date_format(ts, "EEEE"), "month": F.month(ts), "month_name": F.date_format(ts, "MMMM"), "year": F.year(ts), "day": F.dayofmonth(ts),
        "iso_week": F.weekofyear(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"), "fortnight": F.when(F.dayofmonth(ts) <= 15, "Q1").when(ts.isNotNull(), "Q2"), "quarter": F.quarter(ts), "year_month": F.date_format(ts, "yyyy-MM"),
    }


def hour_band(hour: Column, edges: Sequence[int] = DEFAULT_EDGES, labels: Sequence[str] = BANDS, default: str | None = "evening") -> Column:
    """Band of an hour, left-closed; ``default`` for an unknown hour."""
    out = F.lit(default).cast("string")
    for a, b, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((hour >= a) & (hour < b), F.lit(label)).otherwise(out)
    return out


def working_hours(ts: Column, first: int = 8, last: int = 17) -> Column:
    return F.coalesce((F.weekday(ts) < 5) & F.hour(ts).between(first, last), F.lit(False)).cast("int")


def risk_hours(ts: Column) -> Column:
    """Night or weekend."""
    return F.coalesce((F.hour(ts) < DEFAULT_EDGES[1]) | (F.weekday(ts) >= 5), F.lit(False)).cast("int")


@dataclass(frozen=True)
class Calendar:
    """Days that matter: holidays (yyyy-mm-dd), recurring dates (mm-dd to name), ranges (first, last, name), pay days of a month."""

    holidays: tuple[str, ...] = ()
    recurring: tuple[tuple[str, str], ...] = ()
    ranges: tuple[tuple[str, str, str], ...] = ()
    pay_days: tuple[int, ...] = (15, 30)


def calendar_flags(day: Column, calendar: Calendar) -> dict[str, Column]:
    mmdd = F.date_format(day, "MM-dd")
    special = F.lit(None).cast("string")
    for key, name in reversed(calendar.recurring):
        special = F.when(mmdd == key, F.lit(name)).otherwise(special)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"is_holiday": flag(F.date_format(day, "yyyy-MM-dd").isin(*calendar.holidays)) if calendar.holidays else F.lit(0), "special_date": special, "is_pay_day": flag(F.dayofmonth(day).isin(*calendar.pay_days))}


def event_label(day: Column, calendar: Calendar, separator: str = " + ") -> Column:
    """All events of a day in one label: recurring dates, ranges, pay day, holiday; null for none."""
    mmdd, iso = F.date_format(day, "MM-dd"), F.date_format(day, "yyyy-MM-dd")
    names = [F.when(mmdd == k, F.lit(n)) for k, n in calendar.recurring]
    names += [F.when(iso.between(a, b), F.lit(n)) for a, b, n in calendar.ranges]
    names.append(F.when(F.dayofmonth(day).isin(*calendar.pay_days), F.lit("pay day")))
    if calendar.holidays:
        names.append(F.when(iso.isin(*calendar.holidays), F.lit("holiday")))
    return F.nullif(F.concat_ws(separator, *names), F.lit(""))


def days_between(first: Column, last: Column) -> Column:
    """Whole days, rounded down, from one timestamp to another."""
    seconds = F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))
    return F.floor(seconds / 86400)


def fiscal_year(day: Column, first_month: int = 11) -> Column:
    return F.year(day) + (F.month(day) >= first_month).cast("int")


def claim_delay(event: Column, claim: Column, most: int = 730) -> dict[str, Column]:
    """Days from an event to its claim (negative or over ``most``: null), the same in weeks, and a flag for claims without a date."""
    days = days_between(event, claim)
    days = F.when(days.between(0, most), days)
    return {"claim_days": days, "claim_weeks": F.bround(days / 7, 1), "no_claim_date": claim.isNull().cast("int")}

"""Calendar and scaled time features as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0), month, day, year, is_weekend."""
    dow = F.weekday(ts)
    return {
        "hour": F.hour(ts), "day_of_week": dow, "month": F.month(ts),
        "day": F.dayofmonth(ts), "year": F.year(ts),
        "is_weekend": F.when(dow.isin(5, 6), 1).otherwise(0),
    }


# Each feature scaled to [-0.5, 0.5] (fixed divisors of the reference)
def second_of_minute(ts: Column) -> Column:
    return F.second(ts) / 59.0 - 0.5


def minute_of_hour(ts: Column) -> Column:
    return F.minute(ts) / 59.0 - 0.5


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) / 23.0 - 0.5


def day_of_week(ts: Column) -> Column:
    return F.weekday(ts) / 6.0 - 0.5


def day_of_month(ts: Column) -> Column:
    return (F.dayofmonth(ts) - 1) / 30.0 - 0.5


def day_of_year(ts: Column) -> Column:
    return (F.dayofyear(ts) - 1) / 365.0 - 0.5


def month_of_year(ts: Column) -> Column:
    return (F.month(ts) - 1) / 11.0 - 0.5


def week_of_year(ts: Column) -> Column:
    return (F.weekofyear(ts) - 1) / 52.0 - 0.5


# Feature lists per frequency granularity (fixed values of the reference)
_BY_FREQ = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": ["day_of_week", "day_of_month", "day_of_year"],
    "B": ["day_of_week", "day_of_month", "day_of_year"],
    "H": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "T": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", "day_of_week",
          "day_of_month", "day_of_year"],
}
_ALIASES = {"A": "Y", "MIN": "T", "YE": "Y", "QE": "Q", "ME": "M", "BH": "H"}


def features_for_frequency(freq: str) -> list[str]:
    """Names of the N11 features for a frequency string like '15min', 'h', '1D'."""
    m = re.fullmatch(r"\s*\d*\s*([A-Za-z]+)(-[A-Za-z]+)?\s*", freq or "")
    if not m:
        raise RuntimeError(f"Unsupported frequency {freq}")
    g = m.group(1).upper()
    g = _ALIASES.get(g, g)
    if g not in _BY_FREQ:
        raise RuntimeError(f"Unsupported frequency {freq}")
    return list(_BY_FREQ[g])


def time_features(ts: Column, freq: str = "h") -> dict[str, Column]:
    """The scaled features chosen by ``freq`` as named columns."""
    fns = globals()
    return {name: fns[name](ts) for name in features_for_frequency(freq)}


def time_marks(ts: Column, minute_slots: int = 4) -> dict[str, Column]:
    """Integer marks month, day, weekday, hour, minute (in 60/slots buckets)."""
    return {"mark_month": F.month(ts), "mark_day": F.dayofmonth(ts),
            "mark_weekday": F.weekday(ts), "mark_hour": F.hour(ts),
            "mark_minute": (F.minute(ts) / (60 // minute_slots)).cast("int")}

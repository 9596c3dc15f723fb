"""Calendar features of a slot end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import _col


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """n-th weekday of a month (Monday = 0); n < 0 counts from its end."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def federal_holidays(years: range, observed: bool = False) -> list[dt.date]:
    """US federal holidays by rule, with the weekday on which a weekend one is observed if asked for."""
    days = set()
    for y in years:
        days |= {dt.date(y, m, d) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))}
        days |= {_nth(y, 1, 0, 3), _nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)}
    if observed:
        days |= {d + dt.timedelta({5: -1, 6: 1}[d.weekday()]) for d in set(days) if d.weekday() > 4}
    return sorted(days)


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / period
    return F.sin(angle), F.cos(angle)


def slot_of_hour(ts: Column | str, minutes: int = 15, base: int = 0) -> Column:
    return F.floor(F.minute(_col(ts)) / minutes) + base


def is_weekend(ts: Column | str) -> Column:
    return (F.weekday(_col(ts)) >= 5).cast("int")


def is_holiday(ts: Column | str, holidays: list[dt.date], pad_days: int = 0) -> Column:
    days = sorted({d + dt.timedelta(i) for d in holidays for i in range(-pad_days, pad_days + 1)})
    return _col(ts).cast("date").isin([F.lit(d) for d in days]).cast("int") if days else F.lit(0)


def with_calendar(df: DataFrame, ts: str = "window_end", holidays: list[dt.date] | None = None, holiday_pad_days: int = 0, dow_base: int = 0, slot_minutes: int = 15, slot_base: int = 0, slot_period: int = 4) -> DataFrame:
    """Weekend and holiday flags and ten cyclic columns. dow_base 0: Monday = 0; 1: Sunday = 1."""
    c = F.col(ts)
    day = F.dayofweek(c) if dow_base else F.weekday(c)
    parts = {"slot_15m": (slot_of_hour(c, slot_minutes, slot_base), slot_period), "dow": (day, 7), "hou": (F.hour(c), 24), "woy": (F.weekofyear(c), 52), "mon": (F.month(c), 12)}
    holidays = federal_holidays(range(2024, 2027)) if holidays is None else holidays
    out = {"is_weekend": is_weekend(c), "is_holiday": is_holiday(c, holidays, holiday_pad_days)}
    for name, (value, period) in parts.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, period)
    return df.withColumns(out)

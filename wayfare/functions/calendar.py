"""Holidays by rule, as expressions of a date of any year; nothing is joined."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
#: (month, day, first year) of holidays on a fixed date.
FIXED = [(1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)]
#: (month, weekday, n-th) of holidays on a weekday; n = -1 is the last one.
FLOATING = [(1, "Mon", 3), (2, "Mon", 3), (5, "Mon", -1), (9, "Mon", 1), (10, "Mon", 2), (11, "Thu", 4)]


def _code(day: Column) -> Column:
    """(month * 100 + day) * 10 + weekday from Monday = 0; 0 without a date."""
    return F.coalesce((F.month(day) * 100 + F.dayofmonth(day)) * 10 + F.weekday(day), F.lit(0))


def _codes(observed: bool) -> dict[int, list[int]]:
    """The codes of holidays by the first year in which they are; so one lookup of a code decides.

    observed: also those that began in some year (none of them at a year's end), and kept on working days.
    Last weekdays of a month are not in February.
    """
    found: dict[int, list[int]] = {0: []}
    for m, d, since in FIXED:
        near = {move: dt.date(2001, m, d) + dt.timedelta(move) for move in (-1, 0, 1)}
        kept = [(0, w) for w in range(5)] + [(-1, 4), (1, 0)] if observed else [(0, w) for w in range(7)]
        if observed or not since:
            found.setdefault(since, []).extend((near[move].month * 100 + near[move].day) * 10 + w for move, w in kept)
    for m, weekday, n in FLOATING:
        last = 7 * n if n > 0 else (dt.date(2001, m % 12 + 1, 1) - dt.timedelta(1)).day
        found[0].extend((m * 100 + d) * 10 + _WEEKDAYS.index(weekday) for d in range(last - 6, last + 1))
    return found


def _is_holiday(day: Column, code: Column, observed: bool) -> Column:
    def hit(codes: list[int]) -> Column:
        # weekdays as bits, by month and day: a lookup, as a comparison with each code makes the stage's code large
        bits = [0] * (13 * 32)
        for c in codes:
            bits[c // 1000 * 32 + c // 10 % 100] |= 1 << c % 10
        at = F.get(F.expr(f"array({', '.join(map(str, bits))})"), F.floor(code / 1000).cast("int") * 32 + F.floor(code / 10).cast("int") % 100)
        return F.getbit(at, code % 10) == 1

    hits = [hit(codes) if not since else hit(codes) & (day >= F.lit(dt.date(since, 1, 1))) for since, codes in sorted(_codes(observed).items()) if codes]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False))


def is_observed_holiday(day: Column) -> Column:
    """Federal holidays as they are kept: those on a Saturday on Friday, those on a Sunday on Monday. From the date itself, of any year."""
    return _is_holiday(day, _code(day), True)


def is_plain_holiday(day: Column) -> Column:
    """The same days without observance and without those that began later."""
    return _is_holiday(day, _code(day), False)


def _flags(df: DataFrame, date: str, observed: bool, same_year: bool) -> DataFrame:
    """Codes of the three days are columns first; a stage whose code grows beyond 8,000 bytes is not compiled."""
    names = {"IsHoliday": 0, "IsDayBeforeHoliday": 1, "IsDayAfterHoliday": -1}
    days = {m: F.date_add(date, m) if m else F.col(date) for m in names.values()}
    fields = {f"_code{m}": _code(day) for m, day in days.items()}
    near = {m: _is_holiday(day, F.col(f"_code{m}"), observed) for m, day in days.items()}
    if same_year:
        near = {m: c & (F.year(days[m]) == F.year(date)) if m else c for m, c in near.items()}
    return df.withColumns(fields).withColumns({n: F.coalesce(near[m].cast("int"), F.lit(0)) for n, m in names.items()}).drop(*fields)


def add_observed_flags(df: DataFrame, date: str = "FlightDate") -> DataFrame:
    """Holiday, day-before and day-after flags by the calendar with observance; zeros where there is no date."""
    return _flags(df, date, True, False)


def add_plain_flags(df: DataFrame, date: str = "FlightDate") -> DataFrame:
    """The same flags by the plain calendar; December 31 is no day before, as next year's holidays are not looked at."""
    return _flags(df, date, False, True)

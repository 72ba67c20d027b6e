"""Scalar features of a trip as column expressions; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a cancellation against a delay.
CANCEL_WEIGHT = 3.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dep_hour(time: Column | str) -> Column:
    """hhmm to hour; 2400 is hour 0, unparsable is null; there is no upper bound."""
    t = _col(time).try_cast("int")
    return F.when(t == 2400, 0).otherwise(F.floor(t / 100)).cast("int")


def parsed_date(text: Column | str) -> Column:
    return F.try_to_timestamp(_col(text).cast("string")).cast("date")


def is_weekend(day_of_week: Column | str) -> Column:
    return _col(day_of_week).isin(6, 7).cast("int")


def season(month: Column | str) -> Column:
    m = _col(month)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def is_holiday_season(month: Column | str) -> Column:
    return _col(month).isin(11, 12, 1).cast("int")


def cyclic(hour: Column | str) -> tuple[Column, Column]:
    angle = _col(hour) * F.lit(2 * math.pi) / 24
    return F.sin(angle), F.cos(angle)


def route(origin: Column | str = "Origin", dest: Column | str = "Dest") -> Column:
    return F.concat_ws("_", _col(origin), _col(dest))


def distance_band(miles: Column | str) -> Column:
    d = _col(miles)
    return F.when(d < 500, "short").when(d < 1500, "medium").when(d < 3000, "long").otherwise("ultra_long")


def bad_weather(prcp: Column, snow: Column, wspd: Column) -> Column:
    """1 if it rains a millimetre, snows at all or blows at 30; a missing measure is no bad weather."""
    none = F.lit(False)
    return (F.coalesce(prcp >= 1.0, none) | F.coalesce(snow > 0.0, none) | F.coalesce(wspd >= 30.0, none)).cast("int")


def date_parts(date: Column | str) -> dict[str, Column]:
    """Year, month, day, day of the year and ISO weekday of a date."""
    d = _col(date)
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "DayOfWeek": F.weekday(d) + 1,
        "DayOfMonth": F.dayofmonth(d),
        "DayOfYear": F.dayofyear(d),
    }


def risk_label(p: Column | str) -> Column:
    x = _col(p)
    return F.when(x < 0.2, "Low").when(x < 0.5, "Medium").otherwise("High")


def either(p: Column, q: Column) -> Column:
    """Chance that at least one of two independent events happens."""
    return 1 - (1 - p) * (1 - q)


def combined_risk(delay: Column | str = "DelayRate", cancel: Column | str = "CancelRate", weight: float = CANCEL_WEIGHT) -> Column:
    return _col(delay) + weight * _col(cancel)


def cancel_delta_class(delta: Column, band: float = 0.001) -> Column:
    return F.when(F.abs(delta) < band, "near").when(delta > 0, "above").otherwise("below")

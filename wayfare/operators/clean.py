"""Cleaning raw trips and deriving their calendar features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.functions import calendar, flight


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows of monthly or yearly frames, by the names of their columns; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_missing_core(df: DataFrame) -> DataFrame:
    """Rows with all core predictors; the label may be missing."""
    return df.na.drop(subset=[c for c in schema.CORE if c in df.columns])


def drop_diverted(df: DataFrame) -> DataFrame:
    """Rows that were not diverted; an unknown diversion stays."""
    return df.filter(~F.col("Diverted").eqNullSafe(1))


def parse_date(df: DataFrame) -> DataFrame:
    """FlightDate as a date; rows without a valid one go."""
    return df.withColumn("FlightDate", flight.parsed_date("FlightDate")).filter(F.col("FlightDate").isNotNull())


def narrow_types(df: DataFrame) -> DataFrame:
    """Fixed types; NaN labels and distances become null."""
    ints = {c: F.col(c).cast("int") for c in ("Year", "Month", "DayOfWeek", "Cancelled")}
    doubles = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("ArrDel15", "Distance")}
    return df.withColumns(ints | doubles)


def add_dep_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("DepHour", flight.dep_hour("CRSDepTime"))


def drop_bad_hour(df: DataFrame) -> DataFrame:
    return df.filter(F.col("DepHour").isNotNull())


def add_calendar(df: DataFrame) -> DataFrame:
    """Day parts, weekend, season, cyclic hour, route and distance band."""
    sin, cos = flight.cyclic("DepHour")
    return df.withColumns(
        {
            "DayOfMonth": F.dayofmonth("FlightDate"),
            "DayOfYear": F.dayofyear("FlightDate"),
            "IsWeekend": flight.is_weekend("DayOfWeek"),
            "Season": flight.season("Month"),
            "IsHolidaySeason": flight.is_holiday_season("Month"),
            "DepHour_sin": sin,
            "DepHour_cos": cos,
            "Route": flight.route(),
            "DistanceBand": flight.distance_band("Distance"),
        }
    )


def standard_states(df: DataFrame, candidates: dict[str, list[str]] = schema.STATE_CANDIDATES) -> DataFrame:
    """OriginState and DestState from the first candidate column that the frame has, else null."""
    out = {}
    for side, names in candidates.items():
        found = next((c for c in names if c in df.columns), None)
        out[f"{side}State"] = F.col(found).cast("string") if found else F.lit(None).cast("string")
    extra = [c for names in candidates.values() for c in names if c in df.columns and c not in out]
    return df.withColumns(out).drop(*extra)


def year_guard(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.col("Year") == year)


def delay_labelled(df: DataFrame) -> DataFrame:
    return df.filter((F.col("Cancelled") == 0) & F.col("ArrDel15").isNotNull())


def cancel_labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Cancelled").isin(0, 1))


def valid_itineraries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): trips whose ends differ, and the others."""
    same = F.col("Origin").eqNullSafe(F.col("Dest"))
    return df.filter(~same), df.filter(same)


def clean(df: DataFrame) -> DataFrame:
    """Raw trips to typed rows with all calendar features."""
    out = drop_diverted(drop_missing_core(standard_states(df)))
    out = drop_bad_hour(add_dep_hour(narrow_types(parse_date(out))))
    return calendar.add_observed_flags(add_calendar(out))


def split_of(df: DataFrame, train: tuple[int, int], val: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """A split column by year; rows outside all three ranges go."""
    name = F.when(F.col("Year").between(*train), "train").when(F.col("Year").between(*val), "val").when(F.col("Year").between(*test), "test")
    return df.withColumn("split", name).filter(F.col("split").isNotNull())

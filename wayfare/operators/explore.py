"""Comparison queries over historical trips: by hour, airline, airport and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import flight
from wayfare.operators import stats


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; None is no condition."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def labelled(df: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """Trips with a known outcome. Without include_cancelled those with a delay label only, so cancel rates are near zero."""
    known = df.filter(F.col("Cancelled").isin(0, 1))
    return known if include_cancelled else known.filter(F.col("ArrDel15").isNotNull())


def measures(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("Flights"), stats.delay_rate().alias("DelayRate"), stats.cancel_rate().alias("CancelRate"))


def at_least(df: DataFrame, n: int, column: str = "Flights") -> DataFrame:
    return df.filter(F.col(column) >= n)


def percents(df: DataFrame) -> DataFrame:
    return df.withColumns({"DelayRatePct": F.col("DelayRate") * 100.0, "CancelRatePct": F.col("CancelRate") * 100.0})


def hourly_risk(df: DataFrame, least: int = 200, **equal) -> DataFrame:
    """Measures by hour with at least so many trips; nothing if the selection has under twice as many in all."""
    hours = measures(labelled(matching(df, **equal)), ["DepHour"])
    total = F.sum("Flights").over(Window.partitionBy(F.lit(1)))  # over a few hours' rows
    return percents(hours.withColumn("_total", total).filter((F.col("_total") >= 2 * least) & (F.col("Flights") >= least)).drop("_total"))


def hour_month_matrix(df: DataFrame, **equal) -> DataFrame:
    return labelled(matching(df, **equal)).groupBy("Month", "DepHour").agg(stats.delay_rate().alias("DelayRate"))


def hour_lists(hours: DataFrame, k: int = 3) -> DataFrame:
    """(kind, place, DepHour, rate): worst and best hours by delay and worst by cancellation; ties to the earlier hour."""
    parts = []
    for kind, column, down in (("worst_delay", "DelayRate", True), ("best_delay", "DelayRate", False), ("worst_cancel", "CancelRate", True)):
        order = [F.desc(column) if down else F.asc(column), F.asc("DepHour")]
        top = hours.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(*order)))
        parts.append(top.select(F.lit(kind).alias("kind"), "place", "DepHour", F.col(column).alias("rate")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def airlines_on_route(df: DataFrame, origin: str, dest: str, least: int = 100, month: int | None = None, busiest: int = 10) -> DataFrame:
    """Measures by airline; those with enough trips, or the busiest if none has."""
    by = measures(matching(df, Origin=origin, Dest=dest, Month=month), ["Reporting_Airline"])
    some = F.max(F.col("Flights") >= least).over(Window.partitionBy(F.lit(1)))  # over the airlines of one route
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("Flights"), "Reporting_Airline"))
    chosen = by.withColumns({"_some": some, "_place": place})
    chosen = chosen.filter(F.when(F.col("_some"), F.col("Flights") >= least).otherwise(F.col("_place") <= busiest))
    return percents(chosen.drop("_some", "_place"))


def route_summary(df: DataFrame, origin: str, dest: str) -> DataFrame:
    """Delay rate over trips that flew and cancel rate over all."""
    delay = F.avg(F.when((F.col("Cancelled") == 0), F.col("ArrDel15")))
    return matching(df, Origin=origin, Dest=dest).agg(delay.alias("DelayRate"), stats.cancel_rate().alias("CancelRate"), F.count("*").alias("Flights"))


def best_airlines(by_airline: DataFrame) -> DataFrame:
    """One row: the airline with the lowest delay and with the lowest cancel rate; ties by name."""
    best = lambda c: F.min_by("Reporting_Airline", F.struct(c, "Reporting_Airline"))
    return by_airline.agg(best("DelayRate").alias("best_delay"), best("CancelRate").alias("best_cancel"))


def airport_ranking(
    df: DataFrame, metric: str = "DelayRate", side: str = "Origin", focus: str | None = None, least: int = 500, n: int | None = 10, worst: bool = True, **equal
) -> DataFrame:
    """Measures by airport at one end (of trips to or from `focus` at the other), ordered by a metric."""
    other = "Dest" if side == "Origin" else "Origin"
    rows = labelled(matching(df, **{other: focus}, **equal))
    by = at_least(measures(rows, [side]), least).withColumnRenamed(side, "airport")
    by = by.orderBy(F.desc(metric) if worst else F.asc(metric), "airport")
    return percents(by if n is None else by.limit(n))


def state_direct(df: DataFrame, origin_state: str, dest_state: str, least: int = 150, n: int = 5, month: int | None = None) -> DataFrame:
    """Direct options between two states by combined risk."""
    rows = labelled(matching(df, OriginState=origin_state, DestState=dest_state, Month=month))
    by = at_least(measures(rows, ["Origin", "Dest", "Reporting_Airline"]), least).withColumn("CombinedRisk", flight.combined_risk())
    return by.orderBy("CombinedRisk", F.desc("Flights"), "Origin", "Dest", "Reporting_Airline").limit(n)


def simple_routes(df: DataFrame) -> DataFrame:
    return measures(df, ["Origin", "Dest"])


def context_line() -> Column:
    """A sentence on an hour's risk."""
    return F.format_string("%02d:00 has %.1f%% delays and %.2f%% cancellations in %d trips", "DepHour", "DelayRatePct", "CancelRatePct", "Flights")

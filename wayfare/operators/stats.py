"""Historical statistics of a period and attaching them to trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.schema import COUNT
from wayfare.sources.tables import small

ROUTE, AIRLINE = ["Reporting_Airline", "Origin", "Dest"], ["Reporting_Airline"]
SLOT = ["Origin", "Month", "DayOfWeek", "DepHour"]
DAILY, DAILY_AIRLINE = ["Origin", "FlightDate"], ["Origin", "Reporting_Airline", "FlightDate"]


def _rows(df: DataFrame) -> Column:
    return F.sum(COUNT) if COUNT in df.columns else F.count("*")


def _rates(df: DataFrame) -> tuple[Column, Column]:
    """Delay and cancel rate of rows, each of which may stand for many."""
    if COUNT not in df.columns:
        return delay_rate(), cancel_rate()
    mean = lambda x: F.try_divide(F.sum(x * F.col(COUNT)), F.sum(F.when(x.isNotNull(), F.col(COUNT))))
    return mean(F.nanvl("ArrDel15", F.lit(None).cast("double"))), mean(F.col("Cancelled").cast("double"))


def delay_rate() -> Column:
    return F.avg(F.nanvl("ArrDel15", F.lit(None).cast("double")))


def cancel_rate() -> Column:
    return F.avg(F.col("Cancelled").cast("double"))


def period(df: DataFrame, first: int, last: int, or_all: bool = False) -> DataFrame:
    """Rows of the years; with or_all, every row if there are none (decided in the plan, without a second job)."""
    inside = F.col("Year").between(first, last)
    if not or_all:
        return df.filter(inside)
    some = df.agg(F.coalesce(F.max(inside), F.lit(False)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).filter(inside | ~F.col("_some")).drop("_some")


def reliability(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Delay rate, cancel rate and number of trips by key."""
    delay, cancel = _rates(df)
    return df.groupBy(*keys).agg(delay.alias(f"{prefix}DelayRate"), cancel.alias(f"{prefix}CancelRate"), _rows(df).alias(f"{prefix}Flights"))


def volume(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(_rows(df).alias(name))


def hubs(df: DataFrame, airport: str, name: str, share: float = 0.25, least: int = 10_000) -> DataFrame:
    """(airport, airline, 0/1): airlines with a share of the airport's trips and enough of them."""
    return hubs_of(df.groupBy(airport, "Reporting_Airline").agg(_rows(df).alias("_n")), airport, name, share, least)


def hubs_of(counts: DataFrame, airport: str, name: str, share: float, least: int) -> DataFrame:
    """The same of counted trips, (airport, Reporting_Airline, _n)."""
    total = F.sum("_n").over(Window.partitionBy(airport))
    hub = ((F.col("_n") / total >= share) & (F.col("_n") >= least)).cast("int")
    return counts.select(airport, "Reporting_Airline", hub.alias(name))


def global_means(df: DataFrame) -> DataFrame:
    """One row: rates over all trips and mean sizes of slots and days."""
    mean_of = lambda keys, name: volume(df, keys, "_n").agg(F.avg("_n").alias(name))
    delay, cancel = _rates(df)
    out = df.agg(delay.alias("DelayRate"), cancel.alias("CancelRate"))
    for keys, name in ((SLOT, "SlotMean"), (DAILY, "DailyMean"), (DAILY_AIRLINE, "DailyAirlineMean")):
        out = out.crossJoin(mean_of(keys, name))  # one row each
    return out


def attach(df: DataFrame, history: DataFrame, share: float = 0.25, least: int = 10_000, fill: bool = True) -> DataFrame:
    """Trips with the statistics of history: seven left joins, then defaults for what history lacks.

    The statistics are small tables that follow the network and the calendar; trips do not move to meet them, and no task
    gets all trips of an airline.
    """
    tables = {
        tuple(ROUTE): reliability(history, ROUTE, "Route"),
        tuple(AIRLINE): reliability(history, AIRLINE, "Airline"),
        tuple(SLOT): volume(history, SLOT, "OriginSlotFlights"),
        tuple(DAILY): volume(history, DAILY, "OriginDailyFlights"),
        tuple(DAILY_AIRLINE): volume(history, DAILY_AIRLINE, "OriginDailyFlightsAirline"),
        ("Origin", "Reporting_Airline"): hubs(history, "Origin", "IsAirlineHubAtOrigin", share, least),
        ("Dest", "Reporting_Airline"): hubs(history, "Dest", "IsAirlineHubAtDest", share, least),
    }
    out = df
    for keys, table in tables.items():
        out = out.join(small(table), list(keys), "left")
    return fill_missing(out, small(global_means(history))) if fill else out


def fill_missing(df: DataFrame, means: DataFrame) -> DataFrame:
    """Rates by the global mean, counts by zero, slot and day sizes by their means, hub flags by zero; of the columns that df has."""
    m = means.select(*(F.col(c).alias(f"_{c}") for c in means.columns))
    by = {
        "RouteDelayRate": "_DelayRate", "RouteCancelRate": "_CancelRate", "AirlineDelayRate": "_DelayRate", "AirlineCancelRate": "_CancelRate",
        "OriginSlotFlights": "_SlotMean", "OriginDailyFlights": "_DailyMean", "OriginDailyFlightsAirline": "_DailyAirlineMean",
    }
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(d)) for c, d in by.items() if c in df.columns}
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("RouteFlights", "AirlineFlights", "IsAirlineHubAtOrigin", "IsAirlineHubAtDest") if c in df.columns}
    return df.crossJoin(F.broadcast(m)).withColumns(filled | zero).drop(*m.columns)

"""Lookup tables for serving: means of attached measures, climatology, defaults and the state map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators import stats, weather
from wayfare.schema import WEATHER
from wayfare.sources.tables import small, written


def mean_table(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))


def route_meta(df: DataFrame) -> DataFrame:
    return mean_table(df, stats.ROUTE, ["RouteDelayRate", "RouteCancelRate", "RouteFlights"])


def airline_meta(df: DataFrame) -> DataFrame:
    return mean_table(df, stats.AIRLINE, ["AirlineDelayRate", "AirlineCancelRate", "AirlineFlights"])


def slot_meta(df: DataFrame) -> DataFrame:
    return mean_table(df, stats.SLOT, ["OriginSlotFlights"])


def daily_meta(df: DataFrame, by_airline: bool = False) -> DataFrame:
    """Mean number of trips of a day by origin, month and weekday (and airline)."""
    extra = ["Reporting_Airline"] if by_airline else []
    name = "OriginDailyFlightsAirline" if by_airline else "OriginDailyFlights"
    days = df.groupBy("Origin", *extra, "FlightDate", "Month", "DayOfWeek").agg(F.count("*").alias("_n"))
    return days.groupBy("Origin", *extra, "Month", "DayOfWeek").agg(F.avg("_n").alias(name))


def route_pair_meta(df: DataFrame) -> DataFrame:
    return df.groupBy("Origin", "Dest").agg(
        F.avg("Distance").alias("Distance"), F.count("*").alias("Flights"), stats.delay_rate().alias("DelayRate"), stats.cancel_rate().alias("CancelRate")
    )


def route_distance_meta(pairs: DataFrame) -> DataFrame:
    return pairs.select("Origin", "Dest", "Distance")


def climatology(df: DataFrame, side: str) -> DataFrame:
    return mean_table(df, [side, "Month"], [c for c in WEATHER if c.startswith(f"{side}_")])


def defaults(df: DataFrame) -> DataFrame:
    """One row of global statistics; a missing delay rate is 0.2, a missing cancel rate 0."""
    daily = daily_meta(df).agg(F.avg("OriginDailyFlights").alias("global_daily_mean"))
    daily_airline = daily_meta(df, True).agg(F.avg("OriginDailyFlightsAirline").alias("global_daily_airline_mean"))
    one = df.agg(
        F.coalesce(stats.delay_rate(), F.lit(0.2)).alias("global_delay_rate"),
        F.coalesce(stats.cancel_rate(), F.lit(0.0)).alias("global_cancel_rate"),
        F.avg("OriginSlotFlights").alias("global_slot_mean"),
        F.avg("Distance").alias("global_distance_mean"),
        *(F.avg(c).alias(f"global_{c}") for c in WEATHER),
    )
    return one.crossJoin(daily).crossJoin(daily_airline)


def domain(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def airport_states(df: DataFrame) -> DataFrame:
    """(airport, state): the most frequent state, the smallest on ties; what trips from an airport say wins."""
    mode = lambda side: df.groupBy(F.col(side).alias("airport")).agg(F.mode(F.col(f"{side}State"), True).alias(f"_{side}"))
    both = mode("Origin").join(mode("Dest"), "airport", "full_outer")
    return both.select("airport", F.coalesce("_Origin", "_Dest").alias("state")).filter(F.col("state").isNotNull())


class Lattice:
    """Three tables of sums and counts from which all lookup tables roll up, so that prepared trips are read three times.

    months: by airline, both airports with their states, and month; days: by origin, airline and day; slots: by origin, month,
    weekday and hour. Their sizes follow the network and the calendar, not the number of trips; each is written once.
    """

    _MEANS = ["RouteDelayRate", "RouteCancelRate", "RouteFlights", "AirlineDelayRate", "AirlineCancelRate", "AirlineFlights", "Distance", *WEATHER]

    def __init__(self, prepared: DataFrame):
        known = {c: F.col(c).cast("double") for c in [*self._MEANS, "Cancelled"]} | {"ArrDel15": F.nanvl("ArrDel15", F.lit(None).cast("double"))}
        sums = [x for c, v in known.items() for x in (F.sum(v).alias(f"{c}_sum"), F.count(v).alias(f"{c}_n"))]
        states = [c for c in ("OriginState", "DestState") if c in prepared.columns]
        self.months = written(prepared.groupBy("Reporting_Airline", "Origin", "Dest", *states, "Month").agg(*sums, F.count("*").alias("n")))
        self.days = written(prepared.groupBy("Origin", "Reporting_Airline", "FlightDate", "Month", "DayOfWeek").agg(F.count("*").alias("n")))
        slot = F.col("OriginSlotFlights").cast("double")
        self.slots = written(prepared.groupBy(*stats.SLOT).agg(F.sum(slot).alias("slot_sum"), F.count(slot).alias("slot_n")))

    @staticmethod
    def _mean(c: str) -> Column:
        return F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))

    def means(self, keys: list[str], columns: list[str]) -> DataFrame:
        return self.months.groupBy(*keys).agg(*(self._mean(c).alias(c) for c in columns))

    def slot(self) -> DataFrame:
        return self.slots.groupBy(*stats.SLOT).agg(self._mean("slot").alias("OriginSlotFlights"))

    def daily(self, by_airline: bool = False) -> DataFrame:
        extra = ["Reporting_Airline"] if by_airline else []
        counts = self.days.groupBy("Origin", *extra, "FlightDate", "Month", "DayOfWeek").agg(F.sum("n").alias("_n"))
        return counts.groupBy("Origin", *extra, "Month", "DayOfWeek").agg(F.avg("_n").alias("OriginDailyFlightsAirline" if by_airline else "OriginDailyFlights"))

    def hubs(self, airport: str, name: str, share: float, least: int) -> DataFrame:
        return stats.hubs_of(self.months.groupBy(airport, "Reporting_Airline").agg(F.sum("n").alias("_n")), airport, name, share, least)

    def pairs(self) -> DataFrame:
        of = {"Distance": "Distance", "ArrDel15": "DelayRate", "Cancelled": "CancelRate"}
        rates = {name: self._mean(c).alias(name) for c, name in of.items()}
        return self.months.groupBy("Origin", "Dest").agg(rates["Distance"], F.sum("n").alias("Flights"), rates["DelayRate"], rates["CancelRate"])

    def climatology(self, side: str) -> DataFrame:
        return self.means([side, "Month"], [c for c in WEATHER if c.startswith(f"{side}_")])

    def states(self) -> DataFrame:
        """As airport_states()."""

        def mode(side: str) -> DataFrame:
            counts = self.months.filter(F.col(f"{side}State").isNotNull()).groupBy(F.col(side).alias("airport"), F.col(f"{side}State").alias("s")).agg(F.sum("n").alias("n"))
            return counts.groupBy("airport").agg(F.min_by("s", F.struct((-F.col("n")).alias("n"), "s")).alias(f"_{side}"))

        both = mode("Origin").join(mode("Dest"), "airport", "full_outer")
        return both.select("airport", F.coalesce("_Origin", "_Dest").alias("state"))

    def defaults(self) -> DataFrame:
        """As defaults()."""
        one = self.months.agg(
            F.coalesce(self._mean("ArrDel15"), F.lit(0.2)).alias("global_delay_rate"),
            F.coalesce(self._mean("Cancelled"), F.lit(0.0)).alias("global_cancel_rate"),
            self._mean("Distance").alias("global_distance_mean"),
            *(self._mean(c).alias(f"global_{c}") for c in WEATHER),
        )
        slot = self.slots.agg(self._mean("slot").alias("global_slot_mean"))
        daily = self.daily().agg(F.avg("OriginDailyFlights").alias("global_daily_mean"))
        daily_airline = self.daily(True).agg(F.avg("OriginDailyFlightsAirline").alias("global_daily_airline_mean"))
        return one.crossJoin(slot).crossJoin(daily).crossJoin(daily_airline)  # one row each


class DayLattice(Lattice):
    """The same three tables from cleaned trips, without preparing each trip: all trips of an airline between two airports on a day
    get the same statistics and the same weather, so these are looked up once for such a cell and weigh as many trips as it has.

    What follows the cells is bounded by network and calendar. Trips that lie together by origin and day make cells without
    moving twice; they are read twice.
    """

    def __init__(self, trips: DataFrame, first: int, last: int, wx: DataFrame | None = None):
        own = {"Distance": F.col("Distance"), "Cancelled": F.col("Cancelled").cast("double"), "ArrDel15": F.nanvl("ArrDel15", F.lit(None).cast("double"))}
        states = [c for c in ("OriginState", "DestState") if c in trips.columns]
        sums = [x for c, v in own.items() for x in (F.sum(v).alias(f"{c}_sum"), F.count(v).alias(f"{c}_n"))]
        cells = written(trips.groupBy(*stats.ROUTE, *states, "FlightDate", "Year", "Month", "DayOfWeek").agg(*sums, F.count("*").alias("n")))
        slots = written(trips.groupBy("Year", *stats.SLOT).agg(F.count("*").alias("n")))
        past, past_slots = stats.period(cells, first, last), stats.period(slots, first, last).groupBy(*stats.SLOT).agg(F.sum("n").alias("OriginSlotFlights"))
        rates = lambda prefix: [self._mean("ArrDel15").alias(f"{prefix}DelayRate"), self._mean("Cancelled").alias(f"{prefix}CancelRate")]
        means = small(past.agg(*rates("")).crossJoin(past_slots.agg(F.avg("OriginSlotFlights").alias("SlotMean"))).withColumns({c: F.lit(None).cast("double") for c in ("DailyMean", "DailyAirlineMean")}))
        known = cells
        for keys, prefix in ((stats.ROUTE, "Route"), (stats.AIRLINE, "Airline")):
            known = known.join(small(past.groupBy(*keys).agg(*rates(prefix), F.sum("n").alias(f"{prefix}Flights"))), keys, "left")
        known = stats.fill_missing(known, means)
        if wx is not None:
            known = weather.attach_weather(known, wx)
        n = F.col("n")
        weighed = [x for c in self._MEANS if c in known.columns and c not in own for x in (F.sum(F.col(c).cast("double") * n).alias(f"{c}_sum"), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), n)), F.lit(0)).alias(f"{c}_n"))]
        summed = [F.sum(f"{c}_{x}").alias(f"{c}_{x}") for c in own for x in ("sum", "n")]
        self.months = written(known.groupBy("Reporting_Airline", "Origin", "Dest", *states, "Month").agg(*weighed, *summed, F.sum("n").alias("n")))
        self.days = cells
        slot = F.col("OriginSlotFlights")
        known_slots = stats.fill_missing(slots.join(small(past_slots), stats.SLOT, "left"), means)
        self.slots = written(known_slots.groupBy(*stats.SLOT).agg(F.sum(slot * n).alias("slot_sum"), F.coalesce(F.sum(F.when(slot.isNotNull(), n)), F.lit(0)).alias("slot_n")))

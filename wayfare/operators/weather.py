"""Daily airport weather joined to trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions import flight

MEASURES = ("tavg", "prcp", "snow", "wspd")
#: Means that stand in for a measure which the weather table does not have at all.
ABSENT = {"tavg": 15.0, "wspd": 10.0}


def with_endpoints(trips: DataFrame, airports: DataFrame, key: str = "iata") -> DataFrame:
    """Trips whose both ends are in the list."""
    for side in ("Origin", "Dest"):
        trips = trips.join(airports.select(F.col(key).alias(side)).distinct(), side, "left_semi")
    return trips


def attach_side(trips: DataFrame, weather: DataFrame, side: str) -> DataFrame:
    """The weather of the day at one end; days without a record get nulls."""
    have = [m for m in MEASURES if m in weather.columns]
    right = weather.select(F.col("Airport").alias(side), F.col("time").cast("date").alias("FlightDate"), *(F.col(m).alias(f"{side}_{m}") for m in have))
    out = trips.join(right, [side, "FlightDate"], "left")
    return out.withColumns({f"{side}_{m}": F.lit(None).cast("double") for m in MEASURES if m not in have})


def fill_weather(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """Rain and snow by zero, temperature and wind by the weather table's means; then the bad-weather flags."""
    means = weather.agg(*((F.avg(m) if m in weather.columns else F.lit(v)).cast("double").alias(f"_{m}") for m, v in ABSENT.items()))
    out = trips.crossJoin(F.broadcast(means))
    for side in ("Origin", "Dest"):
        fills = {m: F.coalesce(f"{side}_{m}", F.lit(0.0) if m in ("prcp", "snow") else F.col(f"_{m}")) for m in MEASURES}
        out = out.withColumns({f"{side}_{m}": c for m, c in fills.items()})
        out = out.withColumn(f"{side}_BadWeather", flight.bad_weather(*(F.col(f"{side}_{m}") for m in ("prcp", "snow", "wspd"))))
    return out.drop(*means.columns)


def attach_weather(trips: DataFrame, weather: DataFrame) -> DataFrame:
    return fill_weather(attach_side(attach_side(trips, weather, "Origin"), weather, "Dest"), weather)


def busiest_airports(trips: DataFrame, n: int = 100) -> DataFrame:
    """Airports by trips at either end, the n largest."""
    ends = trips.select(F.col("Origin").alias("iata")).unionByName(trips.select(F.col("Dest").alias("iata")))
    return ends.groupBy("iata").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "iata").limit(n)


def us_airports(busy: DataFrame, airports: DataFrame, country: str = "US") -> DataFrame:
    """Busy airports with their coordinates, of one country, those without coordinates left out."""
    some = airports.filter((F.col("country") == country) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return busy.select("iata").join(some, "iata").select("iata", "name", "lat", "lon", "country")


PAYLOAD = (
    "struct<daily: struct<time: array<string>, temperature_2m_mean: array<double>, precipitation_sum: array<double>, "
    "snowfall_sum: array<double>, windspeed_10m_max: array<double>>>"
)


def daily_records(payloads: DataFrame, text: str = "payload", keys: tuple[str, ...] = ("Airport",)) -> DataFrame:
    """One row for each day of a JSON payload of parallel arrays; malformed payloads give none."""
    daily = F.from_json(text, PAYLOAD)["daily"]
    names = ["time", "temperature_2m_mean", "precipitation_sum", "snowfall_sum", "windspeed_10m_max"]
    rows = payloads.select(*keys, F.explode(F.arrays_zip(*(daily[n].alias(n) for n in names))).alias("d"))
    out = rows.select(*keys, *(F.col(f"d.{a}").alias(b) for a, b in zip(names, ("time", *MEASURES))))
    return out.withColumn("BadWeather", flight.bad_weather(F.col("prcp"), F.col("snow"), F.col("wspd")))


def record_of_day(records: DataFrame, day: str) -> DataFrame:
    return records.filter(F.col("time") == day)

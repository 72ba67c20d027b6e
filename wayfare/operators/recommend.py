"""Recommendations for a table of requests: safer hours, airlines, airports, and paths with one stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import flight
from wayfare.operators import explore, stats
from wayfare.operators.features import Metadata, build_features

#: Scores a feature frame: adds a column.
Scorer = Callable[[DataFrame], DataFrame]

REASONS = {
    "holiday_season": "late autumn and winter holidays bring more congestion and weather trouble",
    "summer_peak": "summer is a peak season with more traffic and delays",
    "weekend": "many airports are busier at weekends",
    "route_delay_high": "this route is delayed more often than the network",
    "route_delay_low": "this route is delayed less often than the network",
    "route_cancel_high": "this route is cancelled more often than the network",
    "airline_delay_high": "this airline is delayed more often than the network",
    "airline_delay_low": "this airline is delayed less often than the network",
    "airline_cancel_high": "this airline cancels more often than the network",
    "slot_busy": "the hour is busy at the origin",
    "slot_quiet": "the hour is quiet at the origin",
    "bad_weather": "the weather at either end is often bad in this month",
}


def explain(features: DataFrame, defaults: DataFrame, delay_gap: float = 0.03, cancel_gap: float = 0.002, bad_share: float = 0.35) -> DataFrame:
    """Adds `reasons`, the codes of what raises or lowers the risk, in a fixed order."""
    d = defaults.select(*(F.col(c).alias(f"_{c}") for c in ("global_delay_rate", "global_cancel_rate", "global_slot_mean")))
    c = F.col

    def of(kind: str) -> list[Column]:
        known = c(f"{kind}Flights") > 0
        name = kind.lower()
        return [
            F.when(known & (c(f"{kind}DelayRate") > c("_global_delay_rate") + delay_gap), f"{name}_delay_high").when(
                known & (c(f"{kind}DelayRate") < c("_global_delay_rate") - delay_gap), f"{name}_delay_low"
            ),
            F.when(known & (c(f"{kind}CancelRate") > c("_global_cancel_rate") + cancel_gap), f"{name}_cancel_high"),
        ]

    found = [
        F.when(c("Month").isin(11, 12, 1), "holiday_season").when(c("Month").isin(6, 7, 8), "summer_peak"),
        F.when(c("DayOfWeek").isin(6, 7), "weekend"),
        *of("Route"),
        *of("Airline"),
        F.when(c("OriginSlotFlights") > c("_global_slot_mean") * 1.3, "slot_busy").when(c("OriginSlotFlights") < c("_global_slot_mean") * 0.7, "slot_quiet"),
        F.when((c("Origin_BadWeather") > bad_share) | (c("Dest_BadWeather") > bad_share), "bad_weather"),
    ]
    return features.crossJoin(F.broadcast(d)).withColumn("reasons", F.array_compact(F.array(*found))).drop(*d.columns)


def reason_texts(reasons: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.transform(reasons, lambda r: table[r])


def safer_hours(requests: DataFrame, meta: Metadata, score: Scorer, id_col: str = "request_id", k: int = 3, lower_only: bool = False) -> DataFrame:
    """The k hours of lowest score for each request, its own hour left out; ties to the earlier hour."""
    scored = score(build_features(requests.withColumn("_own", F.col("DepHour")), meta, [id_col, "_own"], hours=list(range(24))))
    return _lowest(scored, F.col("DepHour") == F.col("_own"), id_col, ["DepHour"], k, lower_only)


def safer_airlines(requests: DataFrame, meta: Metadata, score: Scorer, id_col: str = "request_id", k: int = 3, lower_only: bool = False) -> DataFrame:
    """The k airlines of lowest score that fly the request's route, its own left out; ties by name."""
    scored = score(build_features(requests.withColumn("_own", F.col("Reporting_Airline")), meta, [id_col, "_own"], airlines=True))
    return _lowest(scored, F.col("Reporting_Airline") == F.col("_own"), id_col, ["Reporting_Airline"], k, lower_only)


def _lowest(scored: DataFrame, own: Column, id_col: str, ties: list[str], k: int, lower_only: bool) -> DataFrame:
    by = Window.partitionBy(id_col)
    if lower_only:
        scored = scored.withColumn("_at", F.max(F.when(own, F.col("p"))).over(by)).filter(F.col("_at").isNull() | (F.col("p") < F.col("_at")))
    place = F.row_number().over(by.orderBy("p", *ties))
    return scored.filter(~own).withColumn("place", place).filter(F.col("place") <= k).select(id_col, "place", *ties, "p")


def alternative_airports(requests: DataFrame, pairs: DataFrame, states: DataFrame, id_col: str = "request_id", least: int = 200, k: int = 3) -> DataFrame:
    """For each request and side up to k airports of the same state with a direct route of enough trips, by combined risk."""
    good = explore.at_least(pairs, least).withColumn("CombinedRisk", flight.combined_risk())
    parts = []
    for side, other in (("Origin", "Dest"), ("Dest", "Origin")):
        home = states.select(F.col("airport").alias(side), "state")
        near = states.select(F.col("airport").alias("alternative"), "state")
        options = good.select(F.col(side).alias("alternative"), other, "Flights", "DelayRate", "CancelRate", "CombinedRisk")
        rows = requests.select(id_col, "Origin", "Dest").join(home, side).join(near, "state").filter(F.col("alternative") != F.col(side))
        rows = rows.join(options, ["alternative", other])
        place = F.row_number().over(Window.partitionBy(id_col).orderBy("CombinedRisk", F.desc("Flights"), "alternative"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= k)
        parts.append(rows.select(id_col, F.lit(side).alias("side"), "place", "alternative", "Flights", "DelayRate", "CancelRate"))
    return parts[0].unionByName(parts[1])


def _legs(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs of routes that meet in a hub, which is neither end."""
    out = pairs.select("Origin", F.col("Dest").alias("Hub"), *(F.col(c).alias(f"{c}_out") for c in pairs.columns if c not in ("Origin", "Dest")))
    back = pairs.select(F.col("Origin").alias("Hub"), "Dest", *(F.col(c).alias(f"{c}_in") for c in pairs.columns if c not in ("Origin", "Dest")))
    # a leg under the minimum can be in no path, so it goes before the join
    legs = explore.at_least(out, least, "Flights_out").join(explore.at_least(back, least, "Flights_in"), "Hub")
    legs = legs.filter((F.col("Hub") != F.col("Origin")) & (F.col("Hub") != F.col("Dest")))
    delay, cancel = F.col("DelayRate_out") + F.col("DelayRate_in"), F.col("CancelRate_out") + F.col("CancelRate_in")
    return legs.withColumns(
        {
            "MinFlights": F.least("Flights_out", "Flights_in"),
            "CombinedDelay": delay,
            "CombinedCancel": cancel,
            "RiskScore": flight.combined_risk(delay, cancel),
        }
    )


def one_stop(requests: DataFrame, pairs: DataFrame, id_col: str = "request_id", least: int = 150, k: int = 3) -> DataFrame:
    """Up to k paths with one stop for each request: lowest risk, then shortest, then the busiest weaker leg."""
    asked = requests.select(id_col, "Origin", "Dest")
    some = pairs.join(asked.select("Origin").distinct(), "Origin", "left_semi").unionByName(pairs.join(asked.select("Dest").distinct(), "Dest", "left_semi")).distinct()
    legs = _legs(some, least).withColumn("TotalDistance", F.col("Distance_out") + F.col("Distance_in"))
    rows = asked.join(legs, ["Origin", "Dest"])
    order = [F.asc("RiskScore"), F.asc("TotalDistance"), F.desc("MinFlights"), F.asc("Hub")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).filter(F.col("place") <= k)
    return rows.select(id_col, "place", "Origin", "Hub", "Dest", "Flights_out", "Flights_in", "CombinedDelay", "CombinedCancel")


def state_one_stop(df: DataFrame, states: DataFrame, origin_state: str, dest_state: str, least: int = 150, n: int = 5) -> DataFrame:
    """The n best paths with one stop between two states."""
    of = lambda state, name: states.filter(F.col("state") == state).select(F.col("airport").alias(name))
    routes = explore.simple_routes(df)
    legs = _legs(routes, least).join(of(origin_state, "Origin"), "Origin", "left_semi").join(of(dest_state, "Dest"), "Dest", "left_semi")
    return legs.orderBy("RiskScore", F.desc("MinFlights"), "Origin", "Hub", "Dest").limit(n)


def state_recommendation(df: DataFrame, states: DataFrame, origin_state: str, dest_state: str, least: int = 150, n: int = 5) -> DataFrame:
    """Direct options if there are any, else paths with one stop, chosen within one plan."""
    direct = explore.state_direct(df, origin_state, dest_state, least, n)
    direct = direct.select(F.lit("direct").alias("kind"), "Origin", F.lit(None).cast("string").alias("Hub"), "Dest", "Reporting_Airline", F.col("CombinedRisk").alias("Risk"))
    stops = state_one_stop(df, states, origin_state, dest_state, least, n)
    stops = stops.select(F.lit("one_stop").alias("kind"), "Origin", "Hub", "Dest", F.lit(None).cast("string").alias("Reporting_Airline"), F.col("RiskScore").alias("Risk"))
    both = direct.unionByName(stops)  # at most 2n rows
    has_direct = F.max(F.col("kind") == "direct").over(Window.partitionBy(F.lit(1)))
    return both.withColumn("_direct", has_direct).filter((F.col("kind") == "direct") == F.col("_direct")).drop("_direct")


def thin_history(requests: DataFrame, route_meta: DataFrame, id_col: str = "request_id", least: int = 50, k: int = 5) -> DataFrame:
    """How much history a request's airline has on its route, and richer airlines there by combined risk.

    Risks that are equal to nine digits are ties: the table holds means of rates, which may differ in their last bits.
    """
    own = requests.select(id_col, "Reporting_Airline", "Origin", "Dest").join(route_meta, stats.ROUTE, "left")
    kind = F.when(F.coalesce("RouteFlights", F.lit(0)) == 0, "none").when(F.col("RouteFlights") < least, "thin").otherwise("enough")
    others = route_meta.filter(F.col("RouteFlights") >= least).select(
        "Origin", "Dest", F.col("Reporting_Airline").alias("_other"), F.round(flight.combined_risk("RouteDelayRate", "RouteCancelRate"), 9).alias("_risk")
    )
    rows = requests.select(id_col, "Reporting_Airline", "Origin", "Dest").join(others, ["Origin", "Dest"]).filter("_other <> Reporting_Airline")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("_risk", "_other"))
    best = rows.withColumn("_place", place).filter(F.col("_place") <= k).groupBy(id_col)
    listed = best.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_place", "_other"))), lambda x: x["_other"])).alias("richer"))
    out = own.select(id_col, kind.alias("history")).join(listed, id_col, "left")
    return out.withColumn("richer", F.when(F.col("history") == "enough", "").otherwise(F.coalesce("richer", F.lit(""))))


def round_trip(out: DataFrame, back: DataFrame, id_col: str = "request_id", names: tuple[str, ...] = ("p_delay", "p_cancel")) -> DataFrame:
    """Risk that either leg is hit, by request."""
    b = back.select(id_col, *(F.col(n).alias(f"_{n}") for n in names))
    return out.join(b, id_col).select(id_col, *(flight.either(F.col(n), F.col(f"_{n}")).alias(n) for n in names))

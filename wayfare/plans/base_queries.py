"""Queries of cleaning, statistics, weather, serving tables and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.functions import calendar, flight
from wayfare.operators import clean, explore, features, metadata, sampling, stats, weather
from wayfare.plans import views as v
from wayfare.plans.registry import query
from wayfare.sources.tables import written


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, as sums of doubles differ in their last bits with the order of rows."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql(cte: str, body: str, doubles: str = "") -> str:
    """The body with the same columns rounded."""
    if not doubles:
        return f"with {cte} {body}"
    changes = ", ".join(f"round({c}, 9) as {c}" for c in doubles.split())
    return f"with {cte} select * replace ({changes}) from ({body})"


KEYS = ["FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime"]
KEYS_SQL = ", ".join(KEYS)


def tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _holed(trips: DataFrame) -> DataFrame:
    """Trips without one of the core columns, or the label, by the minute of departure."""
    minute = F.col("_minute")
    rows = trips.withColumn("_minute", F.col("CRSDepTime") % 60)
    holes = {c: F.when(minute != i, F.col(c)) for i, c in enumerate(schema.CORE)} | {"ArrDel15": F.when(minute != 30, F.col("ArrDel15"))}
    return rows.withColumns(holes).drop("_minute")


# -- sources and filters ------------------------------------------------------------------------------------------------
query("s5_parquet_scan", f"with {v.TRIPS_SQL} select Origin, Year, count(*) as n from raw group by 1, 2")(
    lambda s, d: tally(v.trips(s, d), "Origin", "Year")
)
query("s6_weather_scan", sql(v.WX_SQL, "select Airport, time, tavg, prcp, snow, wspd from wx", "tavg prcp snow wspd"))(lambda s, d: rounded(v.wx(s, d)))
query("s3_projection", f"with {v.TRIPS_SQL} select {KEYS_SQL}, OriginState, DestState from raw")(
    lambda s, d: clean.standard_states(v.trips(s, d)).select(*KEYS, "OriginState", "DestState")
)
# every core column is missing somewhere, and the label elsewhere, which keeps its row
_HOLES = {c: f"CRSDepTime % 60 = {i}" for i, c in enumerate(schema.CORE)}
_HOLES_SQL = ", ".join(f"case when not ({hole}) then {c} end as {c}" for c, hole in _HOLES.items() if c != "CRSDepTime")
query("f1_missing_core", f"with {v.TRIPS_SQL}, holes as (select {_HOLES_SQL}, case when CRSDepTime % 60 <> {list(schema.CORE).index('CRSDepTime')} then CRSDepTime end as CRSDepTime, case when CRSDepTime % 60 <> 30 then ArrDel15 end as ArrDel15 from raw) select {KEYS_SQL}, ArrDel15 from holes where {' and '.join(f'{c} is not null' for c in schema.CORE)}")(
    lambda s, d: clean.drop_missing_core(_holed(v.trips(s, d))).select(*KEYS, "ArrDel15")
)
query("f2_diverted", f"with {v.TRIPS_SQL} select {KEYS_SQL} from (select *, case when CRSDepTime % 7 = 0 then null else Diverted end as dv from raw) where dv is distinct from 1")(
    lambda s, d: clean.drop_diverted(v.trips(s, d).withColumn("Diverted", F.when(F.col("CRSDepTime") % 7 != 0, F.col("Diverted")))).select(*KEYS)
)
query("f3_parse_date", f"with {v.TRIPS_SQL} select FlightDate, count(*) as n from raw where CRSDepTime % 11 <> 0 group by 1")(
    lambda s, d: tally(
        clean.parse_date(v.trips(s, d).withColumn("FlightDate", F.when(F.col("CRSDepTime") % 11 == 0, "no date").otherwise(F.col("FlightDate").cast("string")))),
        "FlightDate",
    )
)
query("f4_valid_hour", f"with {v.TRIPS_SQL} select {KEYS_SQL}, cast(case when CRSDepTime = 2400 then 0 else CRSDepTime // 100 end as int) as DepHour from raw where CRSDepTime % 13 <> 0")(
    lambda s, d: clean.drop_bad_hour(
        clean.add_dep_hour(v.trips(s, d).withColumn("t", F.col("CRSDepTime")).withColumn("CRSDepTime", F.when(F.col("t") % 13 != 0, F.col("t"))))
    ).select(*KEYS, "DepHour")
)
query("f5_year_guard", f"with {v.TRIPS_SQL} select {KEYS_SQL} from raw where Year = 1997")(lambda s, d: clean.year_guard(v.trips(s, d), 1997).select(*KEYS))
query("f6_delay_labelled", f"with {v.TRIPS_SQL} select {KEYS_SQL}, ArrDel15 from raw where Cancelled = 0 and ArrDel15 is not null")(
    lambda s, d: clean.delay_labelled(v.trips(s, d)).select(*KEYS, "ArrDel15")
)
_ODD = "case when CRSDepTime % 10 = 0 then null when CRSDepTime % 10 = 1 then 2 else Cancelled end"
query("f7_cancel_labelled", f"with {v.TRIPS_SQL}, odd as (select * replace ({_ODD} as Cancelled) from raw) select {KEYS_SQL}, Cancelled from odd where Cancelled in (0, 1)")(
    lambda s, d: clean.cancel_labelled(v.trips(s, d).withColumn("Cancelled", F.expr(_ODD))).select(*KEYS, "Cancelled")
)
query("f8_weather_endpoints", f"with {v.TRIPS_SQL}, {v.AIRPORTS_SQL} select {KEYS_SQL} from raw where Origin in (select iata from airports where lat is not null) and Dest in (select iata from airports where lat is not null)")(
    lambda s, d: weather.with_endpoints(v.trips(s, d), v.airports(s, d).filter("lat is not null")).select(*KEYS)
)
query("f9_dashboard_filter", f"with {v.CLEAN_SQL} select Reporting_Airline, DepHour, count(*) as n from clean where Origin = 'NATION_4' and Month = 3 group by 1, 2")(
    lambda s, d: tally(explore.matching(v.cleaned(s, d), Origin="NATION_4", Reporting_Airline=None, Month=3, OriginState=None), "Reporting_Airline", "DepHour")
)
query("f10_minimum_volume", sql(v.CLEAN_SQL, "select Origin, Dest, count(*) as Flights, avg(ArrDel15) as DelayRate, avg(Cancelled) as CancelRate from clean group by 1, 2 having count(*) >= 100", "DelayRate CancelRate"))(
    lambda s, d: rounded(explore.at_least(explore.measures(v.cleaned(s, d), ["Origin", "Dest"]), 100))
)
query("f11_same_ends", f"with {v.TRIPS_SQL} select Origin, Origin = Dest as rejected, count(*) as n from raw group by 1, 2")(
    lambda s, d: (lambda kept, rejected: tally(kept.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True))), "Origin", "rejected"))(
        *clean.valid_itineraries(v.trips(s, d))
    )
)
query("f12_period_or_all", f"with {v.TRIPS_SQL} select 'some' as kind, Year, count(*) as n from raw where Year between 1995 and 1998 group by 2 union all select 'none', Year, count(*) from raw group by 2")(
    lambda s, d: tally(stats.period(v.trips(s, d), *v.TRAIN, or_all=True).withColumn("kind", F.lit("some")), "kind", "Year").unionByName(
        tally(stats.period(v.trips(s, d), 2050, 2060, or_all=True).withColumn("kind", F.lit("none")), "kind", "Year")
    )
)

# -- scalar features ----------------------------------------------------------------------------------------------------
query("p1_states", f"with {v.TRIPS_SQL} select {KEYS_SQL}, OriginState, cast(null as varchar) as DestState from raw")(
    lambda s, d: clean.standard_states(v.trips(s, d).withColumnRenamed("OriginState", "ORIGIN_STATE_ABR").drop("DestState")).select(*KEYS, "OriginState", "DestState")
)
query("p1_serving_states", f"with {v.TRIPS_SQL} select {KEYS_SQL}, OriginState, DestState from raw")(
    lambda s, d: clean.standard_states(v.trips(s, d).withColumnsRenamed({"OriginState": "OriginStateAbbr", "DestState": "Dest_State"}).withColumn("DestStateName", F.lit("later")), schema.SERVING_STATE_CANDIDATES).select(*KEYS, "OriginState", "DestState")
)
query("p2_types", f"with {v.TRIPS_SQL} select {KEYS_SQL}, Year, Month, DayOfWeek, Cancelled, ArrDel15, Distance from raw")(
    lambda s, d: clean.narrow_types(v.trips(s, d).withColumn("Year", F.col("Year").cast("string")).withColumn("Distance", F.col("Distance").cast("float"))).select(
        *KEYS, "Year", "Month", "DayOfWeek", "Cancelled", "ArrDel15", "Distance"
    )
)
query("p3_dep_hour", f"with {v.TRIPS_SQL} select distinct CRSDepTime, cast(case when CRSDepTime = 2400 then 0 else CRSDepTime // 100 end as int) as DepHour from raw")(
    lambda s, d: clean.add_dep_hour(v.trips(s, d)).select("CRSDepTime", "DepHour").distinct()
)
_CALENDAR = "Year Month DayOfWeek DayOfMonth DayOfYear IsWeekend Season IsHolidaySeason".split()
query("p4_p7_calendar", f"with {v.CLEAN_SQL} select distinct FlightDate, {', '.join(_CALENDAR)} from clean")(
    lambda s, d: v.cleaned(s, d).select("FlightDate", *_CALENDAR).distinct()
)
query("p8_cyclic_hour", sql(v.CLEAN_SQL, "select distinct DepHour, round(DepHour_sin, 9) as DepHour_sin, round(DepHour_cos, 9) as DepHour_cos from clean"))(
    lambda s, d: rounded(v.cleaned(s, d).select("DepHour", "DepHour_sin", "DepHour_cos")).distinct()
)
query("p9_route", f"with {v.CLEAN_SQL} select Route, count(*) as n from clean group by 1")(lambda s, d: tally(v.cleaned(s, d), "Route"))
query("p10_distance_band", f"with {v.CLEAN_SQL} select distinct Distance, DistanceBand from clean")(
    lambda s, d: v.cleaned(s, d).select("Distance", "DistanceBand").distinct()
)
_FLAGS = ["IsHoliday", "IsDayBeforeHoliday", "IsDayAfterHoliday"]
query("p11_holidays_observed", f"with {v.CLEAN_SQL} select distinct FlightDate, {', '.join(_FLAGS)} from clean")(
    lambda s, d: v.cleaned(s, d).select("FlightDate", *_FLAGS).distinct()
)
_PLAIN = "case when exists (select 1 from plain where y = year(FlightDate) and h = FlightDate{}) then 1 else 0 end as {}"
_ANY_YEAR_SQL = f"{v.HOLIDAYS_SQL}, {v.TRIPS_SQL}".replace("range(1970, 2071)", "range(1890, 2111)") + ", days as (select distinct FlightDate + cast((CRSDepTime % 3 - 1) * 33000 as int) as FlightDate from raw)"


@query(
    "p11_p12_any_year",
    f"with {_ANY_YEAR_SQL} select FlightDate, "
    + ", ".join(f"case when FlightDate in (select h {m} from observed) then 1 else 0 end as {c}" for c, m in zip(_FLAGS, ("", "- 1", "+ 1")))
    + ", "
    + ", ".join(f"case when FlightDate in (select cast(h {m} as date) from plain where year(h {m}) = y) then 1 else 0 end as Plain{c}" for c, m in zip(_FLAGS, ("", "- 1", "+ 1")))
    + " from days",
)
def any_year(spark, sf_dir):
    """Both calendars on days some ninety years before and after those of the trips too."""
    moved = F.date_add("FlightDate", (F.col("CRSDepTime") % 3 - 1) * 33000)
    days = v.trips(spark, sf_dir).select(moved.alias("FlightDate")).distinct()
    plain = calendar.add_plain_flags(days).withColumnsRenamed({c: f"Plain{c}" for c in _FLAGS})
    return calendar.add_observed_flags(plain)


query(
    "p12_holidays_plain",
    f"with {v.CLEAN_SQL} select FlightDate, {_PLAIN.format('', _FLAGS[0])}, {_PLAIN.format(' + 1', _FLAGS[1])}, {_PLAIN.format(' - 1', _FLAGS[2])} from (select distinct FlightDate from raw)",
)(lambda s, d: calendar.add_plain_flags(v.trips(s, d).select("FlightDate").distinct()))
query(
    "p13_bad_weather",
    sql(v.WX_SQL, "select Airport, time, case when prcp >= 1 or snow > 0 or wspd >= 30 then 1 else 0 end as BadWeather from wx"),
)(lambda s, d: v.wx(s, d).select("Airport", "time", flight.bad_weather(F.col("prcp"), F.col("snow"), F.col("wspd")).alias("BadWeather")))
query("p14_date_parts", f"with {v.CLEAN_SQL} select distinct FlightDate, Year, Month, DayOfWeek, DayOfMonth, DayOfYear from clean")(
    lambda s, d: v.cleaned(s, d).select("FlightDate", *(c.alias(n) for n, c in flight.date_parts("FlightDate").items())).distinct()
)
query("p15_risk_label", f"with {v.CLEAN_SQL} select case when score < 0.2 then 'Low' when score < 0.5 then 'Medium' else 'High' end as label, count(*) as n from clean group by 1")(
    lambda s, d: tally(v.cleaned(s, d).withColumn("label", flight.risk_label("score")), "label")
)
query("p19_combined_risk", sql(v.CLEAN_SQL, "select Origin, avg(ArrDel15) + 3 * avg(Cancelled) as CombinedRisk from clean group by 1", "CombinedRisk"))(
    lambda s, d: rounded(explore.measures(v.cleaned(s, d), ["Origin"]).select("Origin", flight.combined_risk().alias("CombinedRisk")))
)
query(
    "p17_cancel_delta",
    sql(v.CLEAN_SQL, """select Reporting_Airline, Origin, delta, case when abs(delta) < 0.001 then 'near' when delta > 0 then 'above' else 'below' end as kind
    from (select Reporting_Airline, Origin, avg(Cancelled) - (select avg(Cancelled) from clean) as delta from clean group by 1, 2)""", "delta"),
)(
    lambda s, d: rounded(
        explore.measures(v.cleaned(s, d), ["Reporting_Airline", "Origin"])
        .crossJoin(F.broadcast(v.cleaned(s, d).agg(stats.cancel_rate().alias("_g"))))
        .withColumn("delta", F.col("CancelRate") - F.col("_g"))
        .select("Reporting_Airline", "Origin", "delta", flight.cancel_delta_class(F.col("delta")).alias("kind"))
    )
)

# -- statistics ---------------------------------------------------------------------------------------------------------
_HIST = f"{v.CLEAN_SQL}, hist as (select * from clean where Year between 1995 and 1998)"
_hist = lambda s, d: v.history(v.cleaned(s, d))
query("a1_route", sql(v.ATTACHED_SQL, "select * from a1", "RouteDelayRate RouteCancelRate"))(lambda s, d: rounded(stats.reliability(_hist(s, d), stats.ROUTE, "Route")))
query("a2_airline", sql(v.ATTACHED_SQL, "select * from a2", "AirlineDelayRate AirlineCancelRate"))(lambda s, d: rounded(stats.reliability(_hist(s, d), stats.AIRLINE, "Airline")))
query("a3_slot", f"with {v.ATTACHED_SQL} select * from a3")(lambda s, d: stats.volume(_hist(s, d), stats.SLOT, "OriginSlotFlights"))
query("a4_daily", f"with {v.ATTACHED_SQL} select * from a4")(lambda s, d: stats.volume(_hist(s, d), stats.DAILY, "OriginDailyFlights"))
query("a5_daily_airline", f"with {v.ATTACHED_SQL} select * from a5")(lambda s, d: stats.volume(_hist(s, d), stats.DAILY_AIRLINE, "OriginDailyFlightsAirline"))
query("a6_hub_origin", f"with {v.ATTACHED_SQL} select * from a6")(lambda s, d: stats.hubs(_hist(s, d), "Origin", "IsAirlineHubAtOrigin", v.HUB_SHARE, v.HUB_LEAST))
query("a7_hub_dest", f"with {v.ATTACHED_SQL} select * from a7")(lambda s, d: stats.hubs(_hist(s, d), "Dest", "IsAirlineHubAtDest", v.HUB_SHARE, v.HUB_LEAST))
query("a8_global_means", sql(v.ATTACHED_SQL, "select * from a8", "DelayRate CancelRate SlotMean DailyMean DailyAirlineMean"))(lambda s, d: rounded(stats.global_means(_hist(s, d))))
_ATTACHED = "RouteDelayRate RouteCancelRate RouteFlights AirlineDelayRate AirlineCancelRate AirlineFlights OriginSlotFlights OriginDailyFlights OriginDailyFlightsAirline IsAirlineHubAtOrigin IsAirlineHubAtDest".split()
_ATTACHED_D = "RouteDelayRate RouteCancelRate AirlineDelayRate AirlineCancelRate OriginSlotFlights OriginDailyFlights OriginDailyFlightsAirline"
query("j1_j7_p20_attach", sql(v.ATTACHED_SQL, f"select {KEYS_SQL}, {', '.join(_ATTACHED)} from attached", _ATTACHED_D))(
    lambda s, d: rounded(v.attached(s, d).select(*KEYS, *_ATTACHED))
)
query("f_prepared_features", sql(v.PREPARED_SQL, f"select {', '.join(schema.FEATURES)}, FlightDate, ArrDel15, Cancelled from prepared", " ".join(c for c in schema.NUMERIC if c.split("_")[-1] in ("sin", "cos", "tavg", "prcp", "snow", "wspd") or c in _ATTACHED_D.split())))(
    lambda s, d: rounded(v.prepared(s, d).select(*schema.FEATURES, "FlightDate", "ArrDel15", "Cancelled"))
)

# -- weather ------------------------------------------------------------------------------------------------------------
_W = " ".join(schema.WEATHER)
query("j8_origin_weather", sql(f"{v.TRIPS_SQL}, {v.WX_SQL}", f"select {KEYS_SQL}, {', '.join(f'{m} as Origin_{m}' for m in weather.MEASURES)} from raw left join wx on Airport = Origin and time = FlightDate", " ".join(f"Origin_{m}" for m in weather.MEASURES)))(
    lambda s, d: rounded(weather.attach_side(v.trips(s, d), v.wx(s, d), "Origin").select(*KEYS, *(f"Origin_{m}" for m in weather.MEASURES)))
)
query("j9_p21_weather_filled", sql(v.PREPARED_SQL, f"select {KEYS_SQL}, {', '.join(schema.WEATHER)} from prepared", " ".join(c for c in schema.WEATHER if "Bad" not in c)))(
    lambda s, d: rounded(weather.attach_weather(v.cleaned(s, d), v.wx(s, d)).select(*KEYS, *schema.WEATHER))
)
query("a22_busiest_airports", f"with {v.TRIPS_SQL} select iata, count(*) as n from (select Origin as iata from raw union all select Dest from raw) group by 1 order by n desc, iata limit 10")(
    lambda s, d: weather.busiest_airports(v.trips(s, d), 10)
)
query("j16_us_airports", f"with {v.AIRPORTS_SQL}, {v.TRIPS_SQL}, busy as (select iata, count(*) as n from (select Origin as iata from raw union all select Dest from raw) group by 1 order by n desc, iata limit 20) select iata, name, lat, lon, country from busy join airports using (iata) where country = 'US' and lat is not null")(
    lambda s, d: weather.us_airports(weather.busiest_airports(v.trips(s, d), 20), v.airports(s, d))
)


def payloads(s, d) -> DataFrame:
    """Weather as JSON payloads of parallel arrays, one for each airport and month."""
    by_day = v.wx(s, d).groupBy("Airport", F.date_trunc("month", "time").alias("m")).agg(F.array_sort(F.collect_list(F.struct("time", *weather.MEASURES))).alias("r"))
    names = ("time", "temperature_2m_mean", "precipitation_sum", "snowfall_sum", "windspeed_10m_max")
    arrays = [F.col(f"r.{a}").cast("array<string>" if a == "time" else "array<double>").alias(b) for a, b in zip(("time", *weather.MEASURES), names)]
    return by_day.select("Airport", F.to_json(F.struct(F.struct(*arrays).alias("daily"))).alias("payload"))


_RECORDS = "select Airport, cast(time as varchar) as time, tavg, prcp, snow, wspd, case when prcp >= 1 or snow > 0 or wspd >= 30 then 1 else 0 end as BadWeather from wx"
query("s7_weather_json", sql(v.WX_SQL, _RECORDS, "tavg prcp snow wspd"))(lambda s, d: rounded(weather.daily_records(payloads(s, d))))
query("s7_record_of_day", sql(v.WX_SQL, f"{_RECORDS} where time = date '1996-06-03'", "tavg prcp snow wspd"))(
    lambda s, d: rounded(weather.record_of_day(weather.daily_records(payloads(s, d)), "1996-06-03"))
)

# -- serving tables -----------------------------------------------------------------------------------------------------
def _mean_sql(keys: str, columns: list[str], cte: str = v.PREPARED_SQL) -> str:
    return sql(cte, f"select {keys}, {', '.join(f'avg({c}) as {c}' for c in columns)} from prepared group by all", " ".join(columns))


query("a9_route_meta", _mean_sql("Reporting_Airline, Origin, Dest", ["RouteDelayRate", "RouteCancelRate", "RouteFlights"]))(lambda s, d: rounded(metadata.route_meta(v.attached(s, d))))
query("a10_airline_meta", _mean_sql("Reporting_Airline", ["AirlineDelayRate", "AirlineCancelRate", "AirlineFlights"]))(lambda s, d: rounded(metadata.airline_meta(v.attached(s, d))))
query("a11_slot_meta", _mean_sql("Origin, Month, DayOfWeek, DepHour", ["OriginSlotFlights"]))(lambda s, d: rounded(metadata.slot_meta(v.attached(s, d))))
_DAILY = "select Origin, {x}Month, DayOfWeek, avg(n) as {n} from (select Origin, {x}FlightDate, Month, DayOfWeek, count(*) as n from clean group by all) group by all"
query("a12_daily_meta", sql(v.CLEAN_SQL, _DAILY.format(x="", n="OriginDailyFlights"), "OriginDailyFlights"))(lambda s, d: rounded(metadata.daily_meta(v.cleaned(s, d))))
query("a13_daily_airline_meta", sql(v.CLEAN_SQL, _DAILY.format(x="Reporting_Airline, ", n="OriginDailyFlightsAirline"), "OriginDailyFlightsAirline"))(
    lambda s, d: rounded(metadata.daily_meta(v.cleaned(s, d), True))
)
query("a14_hub_meta", f"with {v.CLEAN_SQL}, hist as (select * from clean), o as ({v._hub_sql('Origin', 'hub')}), e as ({v._hub_sql('Dest', 'hub')}) select 'Origin' as side, Origin as airport, Reporting_Airline, hub from o union all select 'Dest', Dest, Reporting_Airline, hub from e")(
    lambda s, d: stats.hubs(v.cleaned(s, d), "Origin", "hub", v.HUB_SHARE, v.HUB_LEAST).select(F.lit("Origin").alias("side"), F.col("Origin").alias("airport"), "Reporting_Airline", "hub").unionByName(
        stats.hubs(v.cleaned(s, d), "Dest", "hub", v.HUB_SHARE, v.HUB_LEAST).select(F.lit("Dest").alias("side"), F.col("Dest").alias("airport"), "Reporting_Airline", "hub")
    )
)
PAIRS_SQL = "pairs as (select Origin, Dest, avg(Distance) as Distance, count(*) as Flights, avg(ArrDel15) as DelayRate, avg(Cancelled) as CancelRate from clean group by 1, 2)"
query("a15_route_pairs", sql(f"{v.CLEAN_SQL}, {PAIRS_SQL}", "select * from pairs", "Distance DelayRate CancelRate"))(lambda s, d: rounded(metadata.route_pair_meta(v.cleaned(s, d))))
query("a16_route_distance", sql(f"{v.CLEAN_SQL}, {PAIRS_SQL}", "select Origin, Dest, Distance from pairs", "Distance"))(
    lambda s, d: rounded(metadata.route_distance_meta(metadata.route_pair_meta(v.cleaned(s, d))))
)
_side = lambda side: [c for c in schema.WEATHER if c.startswith(side)]
query("a17_origin_climate", _mean_sql("Origin, Month", _side("Origin")))(lambda s, d: rounded(metadata.climatology(v.with_weather(s, d), "Origin")))
query("a18_dest_climate", _mean_sql("Dest, Month", _side("Dest")))(lambda s, d: rounded(metadata.climatology(v.with_weather(s, d), "Dest")))
DEFAULTS_SQL = (
    "defaults as (select coalesce(avg(ArrDel15), 0.2) as global_delay_rate, coalesce(avg(Cancelled), 0) as global_cancel_rate, avg(OriginSlotFlights) as global_slot_mean,"
    f" avg(Distance) as global_distance_mean, {', '.join(f'avg({c}) as global_{c}' for c in schema.WEATHER)},"
    f" (select avg(OriginDailyFlights) from ({_DAILY.format(x='', n='OriginDailyFlights')})) as global_daily_mean,"
    f" (select avg(OriginDailyFlightsAirline) from ({_DAILY.format(x='Reporting_Airline, ', n='OriginDailyFlightsAirline')})) as global_daily_airline_mean from prepared)"
)
_D = "global_delay_rate global_cancel_rate global_slot_mean global_distance_mean global_daily_mean global_daily_airline_mean " + " ".join(f"global_{c}" for c in schema.WEATHER)
query("a19_defaults", sql(f"{v.PREPARED_SQL}, {DEFAULTS_SQL}", "select * from defaults", _D))(lambda s, d: rounded(metadata.defaults(v.prepared(s, d))))
query("a20_domains", f"with {v.CLEAN_SQL} select 'airline' as kind, Reporting_Airline as value from clean group by 2 union all select 'origin', Origin from clean group by 2 union all select 'dest', Dest from clean group by 2")(
    lambda s, d: (lambda seen: metadata.domain(seen, "Reporting_Airline").select(F.lit("airline").alias("kind"), F.col("Reporting_Airline").alias("value"))
    .unionByName(metadata.domain(seen, "Origin").select(F.lit("origin").alias("kind"), F.col("Origin").alias("value")))
    .unionByName(metadata.domain(seen, "Dest").select(F.lit("dest").alias("kind"), F.col("Dest").alias("value"))))(written(v.cleaned(s, d).select("Reporting_Airline", "Origin", "Dest").distinct()))
)
_MODE = "select {s} as airport, {s}State as st from (select {s}, {s}State, row_number() over (partition by {s} order by count(*) desc, {s}State) as k from clean where {s}State is not null group by 1, 2) where k = 1"
STATES_SQL = f"so as ({_MODE.format(s='Origin')}), sd as ({_MODE.format(s='Dest')}), states as (select coalesce(so.airport, sd.airport) as airport, coalesce(so.st, sd.st) as state from so full join sd on so.airport = sd.airport)"
query("a21_airport_states", f"with {v.CLEAN_SQL}, {STATES_SQL} select * from states")(lambda s, d: metadata.airport_states(v.cleaned(s, d)))

# -- features of requests -----------------------------------------------------------------------------------------------
def meta_of(s, d) -> features.Metadata:
    return features.Metadata(v.lattice(s, d), v.HUB_SHARE, v.HUB_LEAST)


_G = {"OriginSlotFlights": "global_slot_mean", "OriginDailyFlights": "global_daily_mean", "OriginDailyFlightsAirline": "global_daily_airline_mean"}
META_SQL = f"""{v.PREPARED_SQL}, {DEFAULTS_SQL}, {STATES_SQL}, {PAIRS_SQL},
m9 as (select Reporting_Airline, Origin, Dest, avg(RouteDelayRate) as RouteDelayRate, avg(RouteCancelRate) as RouteCancelRate, avg(RouteFlights) as RouteFlights from prepared group by 1, 2, 3),
m10 as (select Reporting_Airline, avg(AirlineDelayRate) as AirlineDelayRate, avg(AirlineCancelRate) as AirlineCancelRate, avg(AirlineFlights) as AirlineFlights from prepared group by 1),
m11 as (select Origin, Month, DayOfWeek, DepHour, avg(OriginSlotFlights) as OriginSlotFlights from prepared group by 1, 2, 3, 4),
m12 as ({_DAILY.format(x='', n='OriginDailyFlights')}), m13 as ({_DAILY.format(x='Reporting_Airline, ', n='OriginDailyFlightsAirline')}),
m14o as ({v._hub_sql('Origin', 'IsAirlineHubAtOrigin').replace('from hist', 'from prepared')}), m14d as ({v._hub_sql('Dest', 'IsAirlineHubAtDest').replace('from hist', 'from prepared')}),
m17 as (select Origin, Month, {', '.join(f'avg({c}) as {c}' for c in _side('Origin'))} from prepared group by 1, 2),
m18 as (select Dest, Month, {', '.join(f'avg({c}) as {c}' for c in _side('Dest'))} from prepared group by 1, 2)"""


def features_sql(source: str) -> str:
    """CTE `built` over a CTE of requests."""
    parts = "cast(year(FlightDate) as int) as Year, cast(month(FlightDate) as int) as Month, cast(isodow(FlightDate) as int) as DayOfWeek, cast(day(FlightDate) as int) as DayOfMonth, cast(dayofyear(FlightDate) as int) as DayOfYear"
    fills = ", ".join(
        [f"coalesce({of}{k}Rate, global_{k.lower()}_rate) as {of}{k}Rate" for of in ("Route", "Airline") for k in ("Delay", "Cancel")]
        + [f"coalesce({c}, {g}) as {c}" for c, g in _G.items()]
        + [f"coalesce({c}, global_{c}) as {c}" for c in schema.WEATHER]
        + [f"coalesce({c}, 0) as {c}" for c in ("RouteFlights", "AirlineFlights", "IsAirlineHubAtOrigin", "IsAirlineHubAtDest")]
    )
    flags = ", ".join(_PLAIN.format(*x) for x in (("", _FLAGS[0]), (" + 1", _FLAGS[1]), (" - 1", _FLAGS[2])))
    return f"""q0 as (select *, {parts} from {source}),
built as (select q0.*, case when q0.DayOfWeek in (6, 7) then 1 else 0 end as IsWeekend,
    case when q0.Month in (12, 1, 2) then 'winter' when q0.Month in (3, 4, 5) then 'spring' when q0.Month in (6, 7, 8) then 'summer' else 'autumn' end as Season,
    case when q0.Month in (11, 12, 1) then 1 else 0 end as IsHolidaySeason, sin(2 * pi() * DepHour / 24) as DepHour_sin, cos(2 * pi() * DepHour / 24) as DepHour_cos,
    Origin || '_' || Dest as Route, case when Distance < 500 then 'short' when Distance < 1500 then 'medium' when Distance < 3000 then 'long' else 'ultra_long' end as DistanceBand,
    {flags}, {fills}, coalesce(os.state, 'Unknown') as OriginState, coalesce(ds.state, 'Unknown') as DestState
  from q0 left join m9 using (Reporting_Airline, Origin, Dest) left join m10 using (Reporting_Airline) left join m11 using (Origin, Month, DayOfWeek, DepHour)
    left join m12 using (Origin, Month, DayOfWeek) left join m13 using (Origin, Reporting_Airline, Month, DayOfWeek) left join m14o using (Origin, Reporting_Airline)
    left join m14d using (Dest, Reporting_Airline) left join m17 using (Origin, Month) left join m18 using (Dest, Month)
    left join states os on os.airport = Origin left join states ds on ds.airport = Dest cross join defaults)"""


_DOUBLES = " ".join(c for c in schema.NUMERIC if c not in ("Year", "Month", "DayOfWeek", "DayOfMonth", "DayOfYear", "DepHour", "IsWeekend", "IsHolidaySeason", *_FLAGS, "IsAirlineHubAtOrigin", "IsAirlineHubAtDest"))
query("b1_build_features", sql(f"{META_SQL}, {v.REQUESTS_SQL}, {features_sql('requests')}", f"select request_id, {', '.join(schema.FEATURES)} from built", _DOUBLES))(
    lambda s, d: (lambda meta: rounded(features.build_features(v.requests(v.flown(s, d)), meta)))(meta_of(s, d))
)
query(
    "b2_distance_default",
    sql(f"{v.CLEAN_SQL}, {PAIRS_SQL}, {v.REQUESTS_SQL}", """select request_id, coalesce(case when DepHour % 2 = 0 then r.Distance end, case when DepHour % 3 = 0 then null else p.Distance end,
      (select avg(Distance) from clean)) as Distance from requests r left join pairs p on p.Origin = r.Origin and p.Dest = r.Dest""", "Distance"),
)(
    lambda s, d: (lambda rows: rounded(
        features.with_distance(
            v.requests(rows).withColumns({"Distance": F.when(F.col("DepHour") % 2 == 0, F.col("Distance")), "Dest": F.when((F.col("DepHour") % 3 == 0), F.lit("nowhere")).otherwise(F.col("Dest"))}),
            metadata.route_pair_meta(rows),
            rows.agg(F.avg("Distance").alias("global_distance_mean")),
        ).select("request_id", "Distance")
    ))(v.flown(s, d))
)
query("b3_feature_matrix", sql(f"{META_SQL}, flown as (select FlightDate, DepHour, Reporting_Airline, Origin, Dest, Distance, ArrDel15, Cancelled from clean where Year = 2001), {features_sql('flown')}", f"select ArrDel15, Cancelled, {', '.join(schema.FEATURES)} from built", _DOUBLES))(
    lambda s, d: (lambda meta: rounded(features.build_features(features.itineraries(clean.year_guard(v.flown(s, d), 2001)), meta)))(meta_of(s, d))
)

# -- samples: exact sizes are SQL, the rows themselves are not -----------------------------------------------------------
query("m1_balanced_sizes", f"with {v.CLEAN_SQL} select Year, Month, least(count(*), 300 // 12) as n from clean group by 1, 2")(
    lambda s, d: tally(sampling.balanced(v.cleaned(s, d), 300), "Year", "Month")
)
query("m1_balanced")(lambda s, d: sampling.balanced(v.cleaned(s, d).select(*KEYS, "Year", "Month", "score"), 300))
query("m2_take")(lambda s, d: sampling.take(v.cleaned(s, d).select(*KEYS, "score"), 500))
query("m3_negative_sizes", f"with {v.CLEAN_SQL}, l as (select cast(ArrDel15 as int) as label from clean where Cancelled = 0 and ArrDel15 is not null) select label, case when label = 1 then count(*) else greatest(1, cast(floor(count(*) * 0.3) as bigint)) end as n from l group by 1")(
    lambda s, d: tally(sampling.negatives(v.scored(s, d).select("label", "p", "Year", "Reporting_Airline"), "label"), "label")
)
query("m4_stratified_sizes", f"with {v.SCORED_SQL} select label, cast(greatest(1, floor(count(*) * 2000 / cast((select count(*) from scored) as double))) as bigint) as n from scored group by 1")(
    lambda s, d: tally(sampling.stratified(v.scored(s, d).select("label", "p", "Year", "Reporting_Airline"), "label", 2000), "label")
)
query("m5_cap_size", f"with {v.SCORED_SQL} select least(count(*), 1000) as n from scored")(lambda s, d: sampling.take(v.scored(s, d).select("label", "p"), 1000).agg(F.count("*").alias("n")))
query("m6_split", f"with {v.CLEAN_SQL} select case when Year <= 1998 then 'train' when Year = 1999 then 'val' else 'test' end as split, count(*) as n from clean where Year between 1995 and 2001 group by 1")(
    lambda s, d: tally(clean.split_of(v.cleaned(s, d), v.TRAIN, v.VAL, v.TEST), "split")
)

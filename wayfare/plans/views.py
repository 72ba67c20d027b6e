"""Trips, weather and airports derived from the star-schema tables, as DataFrames and as the SQL that oracles use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import calendar, flight
from wayfare.operators import clean, metadata, stats, weather
from wayfare.schema import COUNT
from wayfare.sources.tables import known, once, small, written

#: Years of the statistics period (and of training), of validation and of testing.
TRAIN, VAL, TEST = (1995, 1998), (1999, 1999), (2000, 2001)
#: Hub thresholds that fit the tables' volumes.
HUB_SHARE, HUB_LEAST = 0.22, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw trip for each line item: from the supplier's nation to the customer's.

    Line items are the large table, so orders find their customers first, what line items carry is made before they move, and
    names of nations come last.
    """
    t = lambda name: table(spark, sf_dir, name)
    n, r = t("nation"), t("region")
    end = lambda side, key: n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias(key), F.col("n_name").alias(side), F.col("r_name").alias(f"{side}State")
    )
    supplier, customer = t("supplier").select("s_suppkey", "s_nationkey"), t("customer").select("c_custkey", "c_nationkey")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    part = t("part").select("p_partkey", "p_size")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_nationkey")
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    hour = F.col("l_partkey") % 24
    line = line.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("FlightDate"),
        F.when(hour == 0, 2400).otherwise(hour * 100 + F.col("l_orderkey") % 60).cast("int").alias("CRSDepTime"),
        (F.round(F.col("l_tax") * 100) == 8).alias("_cancelled"),
        ((F.col("l_returnflag") == "R") & (hour >= 12)).alias("_late"),
        (F.col("l_quantity") == 50).alias("_diverted"),
        (F.col("l_extendedprice").cast("double") / 105000.0).alias("score"),
    )
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(end("Origin", "s_nationkey"), "s_nationkey").join(end("Dest", "c_nationkey"), "c_nationkey")
    parts = flight.date_parts("FlightDate")
    return j.select(
        "FlightDate",
        *(parts[c].alias(c) for c in ("Year", "Month", "DayOfWeek")),
        F.col("o_orderpriority").alias("Reporting_Airline"),
        "Origin",
        "Dest",
        "OriginState",
        "DestState",
        "CRSDepTime",
        (F.col("p_size") * 80).cast("double").alias("Distance"),
        F.col("_cancelled").cast("int").alias("Cancelled"),
        F.col("_diverted").cast("int").alias("Diverted"),
        F.when(~F.col("_cancelled"), F.col("_late").cast("double")).alias("ArrDel15"),
        "score",
    )


TRIPS_SQL = """raw as (
  select t.*, cast(year(FlightDate) as int) as Year, cast(month(FlightDate) as int) as Month, cast(isodow(FlightDate) as int) as DayOfWeek
  from (select cast(l_shipdate as date) as FlightDate, o_orderpriority as Reporting_Airline,
      sn.n_name as Origin, cn.n_name as Dest, sr.r_name as OriginState, dr.r_name as DestState,
      cast(case when l_partkey % 24 = 0 then 2400 else (l_partkey % 24) * 100 + l_orderkey % 60 end as int) as CRSDepTime,
      cast(p_size * 80 as double) as Distance,
      case when round(l_tax * 100) = 8 then 1 else 0 end as Cancelled,
      case when l_quantity = 50 then 1 else 0 end as Diverted,
      cast(case when round(l_tax * 100) = 8 then null when l_returnflag = 'R' and l_partkey % 24 >= 12 then 1 else 0 end as double) as ArrDel15,
      cast(l_extendedprice as double) / cast(105000 as double) as score
    from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
      join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
      join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey
      join region sr on sn.n_regionkey = sr.r_regionkey join region dr on cn.n_regionkey = dr.r_regionkey) t)"""


def wx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather by airport, one row for each (nation, order date)."""
    t = lambda name: table(spark, sf_dir, name)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    price = F.col("o_totalprice").cast("double")
    return o.groupBy(F.col("n_name").alias("Airport"), F.col("o_orderdate").cast("date").alias("time")).agg(
        (F.avg(price) / 20000).alias("tavg"),
        (F.count("*") - 1).cast("double").alias("prcp"),
        (F.sum((F.col("o_orderpriority") == "1-URGENT").cast("int")) * 0.5).alias("snow"),
        (F.max(price) / 12500).alias("wspd"),
    )


WX_SQL = """wx as (
  select n_name as Airport, cast(o_orderdate as date) as time, avg(cast(o_totalprice as double)) / 20000 as tavg,
    cast(count(*) - 1 as double) as prcp, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) * cast(0.5 as double) as snow,
    max(cast(o_totalprice as double)) / 12500 as wspd
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by n_name, cast(o_orderdate as date))"""


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An airport dimension; one in seven has no latitude, and two regions count as the US."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("iata"),
        F.concat("n_name", F.lit(" airport")).alias("name"),
        F.when(n % 7 != 0, n.cast("double") * 2.0).alias("lat"),
        (n.cast("double") * -3.0).alias("lon"),
        F.when(F.col("n_regionkey").isin(1, 2), "US").otherwise("XX").alias("country"),
    )


AIRPORTS_SQL = """airports as (
  select n_name as iata, n_name || ' airport' as name, case when n_nationkey % 7 <> 0 then cast(n_nationkey as double) * 2 end as lat,
    cast(n_nationkey as double) * -3 as lon, case when n_regionkey in (1, 2) then 'US' else 'XX' end as country from nation)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned trips, from the query's table of them if attached() has written one."""
    found = known(("cleaned", sf_dir))
    return clean.clean(trips(spark, sf_dir)) if found is None else found


HOLIDAYS_SQL = """years as (select cast(range as int) as y from range(1970, 2071)),
firsts as (select y, m, make_date(y, m, 1) as f, last_day(make_date(y, m, 1)) as l from years, (select unnest([1, 2, 5, 9, 10, 11]) as m)),
floating as (select y, m, case m when 5 then l - cast((isodow(l) - 1) as int) when 11 then f + cast((11 - isodow(f)) % 7 + 21 as int)
    else f + cast((8 - isodow(f)) % 7 + case m when 9 then 0 when 10 then 7 else 14 end as int) end as d from firsts),
fixed as (select y, md.mm as m, make_date(y, md.mm, md.dd) as d from years,
    (select unnest([{'mm': 1, 'dd': 1, 's': 0}, {'mm': 6, 'dd': 19, 's': 2021}, {'mm': 7, 'dd': 4, 's': 0}, {'mm': 11, 'dd': 11, 's': 0}, {'mm': 12, 'dd': 25, 's': 0}]) as md)
    where y >= md.s),
observed as (select distinct h from (select cast(d as date) as h from floating union all
    select cast(case isodow(d) when 6 then d - 1 when 7 then d + 1 else d end as date) from fixed)),
plain as (select distinct y, cast(d as date) as h from (select y, d from floating union all select y, d from fixed where m <> 6))"""

CLEAN_SQL = f"""{HOLIDAYS_SQL}, {TRIPS_SQL},
clean as (select FlightDate, Year, Month, DayOfWeek, Reporting_Airline, Origin, Dest, OriginState, DestState, CRSDepTime, Distance, Cancelled,
    Diverted, ArrDel15, score, cast(case when CRSDepTime = 2400 then 0 else CRSDepTime // 100 end as int) as DepHour,
    cast(day(FlightDate) as int) as DayOfMonth, cast(dayofyear(FlightDate) as int) as DayOfYear,
    case when DayOfWeek in (6, 7) then 1 else 0 end as IsWeekend,
    case when Month in (12, 1, 2) then 'winter' when Month in (3, 4, 5) then 'spring' when Month in (6, 7, 8) then 'summer' else 'autumn' end as Season,
    case when Month in (11, 12, 1) then 1 else 0 end as IsHolidaySeason,
    sin(2 * pi() * (case when CRSDepTime = 2400 then 0 else CRSDepTime // 100 end) / 24) as DepHour_sin,
    cos(2 * pi() * (case when CRSDepTime = 2400 then 0 else CRSDepTime // 100 end) / 24) as DepHour_cos,
    Origin || '_' || Dest as Route,
    case when Distance < 500 then 'short' when Distance < 1500 then 'medium' when Distance < 3000 then 'long' else 'ultra_long' end as DistanceBand,
    case when FlightDate in (select h from observed) then 1 else 0 end as IsHoliday,
    case when FlightDate in (select h - 1 from observed) then 1 else 0 end as IsDayBeforeHoliday,
    case when FlightDate in (select h + 1 from observed) then 1 else 0 end as IsDayAfterHoliday
  from raw where Diverted is distinct from 1)"""


def history(df: DataFrame) -> DataFrame:
    return stats.period(df, *TRAIN)


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned trips with the statistics of the training years."""
    rows = once(("cleaned", sf_dir), lambda: written(cleaned(spark, sf_dir)))  # seven statistics and the join read it
    return stats.attach(rows, history(rows), HUB_SHARE, HUB_LEAST)


#: What serving tables and requests ask of cleaned trips.
FLOWN = [
    "FlightDate", "Year", "Month", "DayOfWeek", "Reporting_Airline", "Origin", "Dest", "OriginState", "DestState", "DepHour", "Distance", "Cancelled", "ArrDel15",
]


def flown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These columns of cleaned trips: of the query's table of them, or written once by origin and day, so that a task has few cells."""

    def narrow() -> DataFrame:
        rows = cleaned(spark, sf_dir)
        some = rows.select(*(c for c in FLOWN if c in rows.columns))
        return some if known(("cleaned", sf_dir)) is not None else written(some.repartition("Origin", "FlightDate"))

    return once(("flown", sf_dir), narrow)


def lattice(spark: SparkSession, sf_dir: str, with_weather: bool = True) -> metadata.Lattice:
    """Sums from which the serving tables roll up; no trip is prepared for them."""
    return metadata.DayLattice(flown(spark, sf_dir), *TRAIN, small(wx(spark, sf_dir)) if with_weather else None)


def with_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned trips with weather alone; columns that a query does not ask for are not made."""
    return weather.attach_weather(cleaned(spark, sf_dir), small(wx(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with statistics and weather: the input of training and of the serving tables, made once in a query."""
    return once(("prepared", sf_dir), lambda: written(weather.attach_weather(attached(spark, sf_dir), small(wx(spark, sf_dir)))))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared trips as models read them, made once in a query: trips that agree in all that features and labels are made of are one row with their number.

    Only these few columns of the trips move; calendar, statistics and weather are looked up for the distinct ones, which
    network and calendar bound. A query that has made prepared trips reads those.
    """
    if (found := known(("prepared", sf_dir))) is not None:
        return found

    def make() -> DataFrame:
        flights = known(("flown", sf_dir))
        flights = cleaned(spark, sf_dir).select(*FLOWN) if flights is None else flights
        distinct = flights.groupBy(*FLOWN).agg(F.count("*").alias(COUNT))
        rows = written(calendar.add_observed_flags(clean.add_calendar(distinct)))
        return written(weather.attach_weather(stats.attach(rows, history(rows), HUB_SHARE, HUB_LEAST), small(wx(spark, sf_dir))))

    return once(("cells", sf_dir), make)


def _hub_sql(airport: str, name: str) -> str:
    return (
        f"select {airport}, Reporting_Airline, case when n >= {HUB_LEAST} and n / sum(n) over (partition by {airport}) >= {HUB_SHARE} then 1 else 0 end as {name}"
        f" from (select {airport}, Reporting_Airline, count(*) as n from hist group by 1, 2)"
    )


ATTACHED_SQL = f"""{CLEAN_SQL}, hist as (select * from clean where Year between {TRAIN[0]} and {TRAIN[1]}),
a1 as (select Reporting_Airline, Origin, Dest, avg(ArrDel15) as RouteDelayRate, avg(Cancelled) as RouteCancelRate, count(*) as RouteFlights from hist group by 1, 2, 3),
a2 as (select Reporting_Airline, avg(ArrDel15) as AirlineDelayRate, avg(Cancelled) as AirlineCancelRate, count(*) as AirlineFlights from hist group by 1),
a3 as (select Origin, Month, DayOfWeek, DepHour, count(*) as OriginSlotFlights from hist group by 1, 2, 3, 4),
a4 as (select Origin, FlightDate, count(*) as OriginDailyFlights from hist group by 1, 2),
a5 as (select Origin, Reporting_Airline, FlightDate, count(*) as OriginDailyFlightsAirline from hist group by 1, 2, 3),
a6 as ({_hub_sql("Origin", "IsAirlineHubAtOrigin")}), a7 as ({_hub_sql("Dest", "IsAirlineHubAtDest")}),
a8 as (select avg(ArrDel15) as DelayRate, avg(Cancelled) as CancelRate, (select avg(OriginSlotFlights) from a3) as SlotMean,
    (select avg(OriginDailyFlights) from a4) as DailyMean, (select avg(OriginDailyFlightsAirline) from a5) as DailyAirlineMean from hist),
attached as (select clean.*, coalesce(RouteDelayRate, DelayRate) as RouteDelayRate, coalesce(RouteCancelRate, CancelRate) as RouteCancelRate,
    cast(coalesce(RouteFlights, 0) as int) as RouteFlights, coalesce(AirlineDelayRate, DelayRate) as AirlineDelayRate,
    coalesce(AirlineCancelRate, CancelRate) as AirlineCancelRate, cast(coalesce(AirlineFlights, 0) as int) as AirlineFlights,
    coalesce(cast(OriginSlotFlights as double), SlotMean) as OriginSlotFlights, coalesce(cast(OriginDailyFlights as double), DailyMean) as OriginDailyFlights,
    coalesce(cast(OriginDailyFlightsAirline as double), DailyAirlineMean) as OriginDailyFlightsAirline,
    coalesce(IsAirlineHubAtOrigin, 0) as IsAirlineHubAtOrigin, coalesce(IsAirlineHubAtDest, 0) as IsAirlineHubAtDest
  from clean left join a1 using (Reporting_Airline, Origin, Dest) left join a2 using (Reporting_Airline)
    left join a3 using (Origin, Month, DayOfWeek, DepHour) left join a4 using (Origin, FlightDate)
    left join a5 using (Origin, Reporting_Airline, FlightDate) left join a6 using (Origin, Reporting_Airline)
    left join a7 using (Dest, Reporting_Airline) cross join a8)"""


def _weather_sql(side: str) -> str:
    measures = ", ".join(
        f"coalesce({side[0].lower()}w.{m}, {'0' if m in ('prcp', 'snow') else f'(select avg({m}) from wx)'}) as {side}_{m}" for m in ("tavg", "prcp", "snow", "wspd")
    )
    return measures


def _bad_sql(side: str) -> str:
    return f"case when {side}_prcp >= 1 or {side}_snow > 0 or {side}_wspd >= 30 then 1 else 0 end as {side}_BadWeather"


PREPARED_SQL = f"""{ATTACHED_SQL}, {WX_SQL},
prepared as (select *, {_bad_sql("Origin")}, {_bad_sql("Dest")} from (
  select attached.*, {_weather_sql("Origin")}, {_weather_sql("Dest")} from attached
    left join wx ow on ow.Airport = Origin and ow.time = FlightDate left join wx dw on dw.Airport = Dest and dw.time = FlightDate))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled trips with a score that knows nothing and one that knows the hour."""
    rows = clean.delay_labelled(cleaned(spark, sf_dir))
    hour = (F.col("DepHour") / 24.0).alias("p_b")
    return rows.select(F.col("ArrDel15").cast("int").alias("label"), F.col("score").alias("p"), F.col("score").alias("p_a"), hour, "Year", "Reporting_Airline")


SCORED_SQL = f"""{CLEAN_SQL},
scored as (select cast(ArrDel15 as int) as label, score as p, score as p_a, DepHour / 24.0::double as p_b, Year, Reporting_Airline
  from clean where Cancelled = 0 and ArrDel15 is not null)"""


def requests(rows: DataFrame) -> DataFrame:
    """One request for each (airline, origin, destination, hour) that flew: its last day there, and its longest distance of that day.

    Two aggregations by hash, the second of trips of the last days; one of both columns together would sort all trips. rows
    are read twice, so they are to be written ones.
    """
    keys = ["Reporting_Airline", "Origin", "Dest", "DepHour"]
    last = rows.groupBy(*keys).agg(F.max("FlightDate").alias("FlightDate"))
    joined = rows.alias("r").join(small(last).alias("l"), [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*keys, "FlightDate"]])
    found = joined.groupBy(*(F.col(f"l.{k}").alias(k) for k in [*keys, "FlightDate"])).agg(F.max("r.Distance").alias("Distance"))
    return found.select(F.concat_ws("|", *keys).alias("request_id"), *keys, "FlightDate", "Distance")


REQUESTS_SQL = """requests as (select concat_ws('|', Reporting_Airline, Origin, Dest, DepHour) as request_id, Reporting_Airline, Origin, Dest, DepHour,
    max(FlightDate) as FlightDate, max(struct_pack(d := FlightDate, x := Distance)).x as Distance from clean group by all)"""

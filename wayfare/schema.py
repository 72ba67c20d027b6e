"""The feature contract of a prepared trip."""

# The models' columns in their order, the groups of the ablation, and names of state columns.
CORE = [
    "Year", "Month", "DayOfWeek", "FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "Distance", "Cancelled",
]
NUMERIC = [
    "Year", "Month", "DayOfWeek", "DayOfMonth", "DayOfYear", "DepHour", "IsWeekend", "IsHolidaySeason", "IsHoliday",
    "IsDayBeforeHoliday", "IsDayAfterHoliday", "Distance", "RouteDelayRate", "RouteCancelRate", "RouteFlights",
    "AirlineDelayRate", "AirlineCancelRate", "AirlineFlights", "OriginSlotFlights", "OriginDailyFlights",
    "OriginDailyFlightsAirline", "IsAirlineHubAtOrigin", "IsAirlineHubAtDest", "DepHour_sin", "DepHour_cos", "Origin_tavg",
    "Origin_prcp", "Origin_snow", "Origin_wspd", "Origin_BadWeather", "Dest_tavg", "Dest_prcp", "Dest_snow", "Dest_wspd",
    "Dest_BadWeather",
]
CATEGORICAL = ["Reporting_Airline", "Origin", "Dest", "Route", "Season", "DistanceBand", "OriginState", "DestState"]
FEATURES = NUMERIC + CATEGORICAL
#: A table may have this column: how many equal rows a row stands for. Statistics, models and metrics weigh rows by it.
COUNT = "n_equal"
CALENDAR = [
    "Year", "Month", "DayOfWeek", "DayOfMonth", "DayOfYear", "IsWeekend", "IsHolidaySeason", "IsHoliday",
    "IsDayBeforeHoliday", "IsDayAfterHoliday", "DepHour", "DepHour_sin", "DepHour_cos", "Season",
]
NETWORK = [
    "RouteDelayRate", "RouteCancelRate", "RouteFlights", "AirlineDelayRate", "AirlineCancelRate", "AirlineFlights",
    "OriginSlotFlights", "OriginDailyFlights", "OriginDailyFlightsAirline", "IsAirlineHubAtOrigin", "IsAirlineHubAtDest",
    "Origin", "Dest", "Route", "Distance", "DistanceBand",
]
WEATHER = [
    "Origin_tavg", "Origin_prcp", "Origin_snow", "Origin_wspd", "Origin_BadWeather", "Dest_tavg", "Dest_prcp", "Dest_snow",
    "Dest_wspd", "Dest_BadWeather",
]
#: Columns of each model of the ablation.
ABLATION = {
    "calendar_only": CALENDAR,
    "route_airline_congestion_only": NETWORK,
    "weather_only": WEATHER,
    "all_features": FEATURES,
    "no_weather": [c for c in FEATURES if c not in WEATHER],
}
#: Names under which a state column may arrive; the first that a frame has is taken.
STATE_CANDIDATES = {
    side: [f"{side}State", f"{side.upper()}_STATE_ABR", f"{side}StateName", f"{side.upper()}_STATE_NM"] for side in ("Origin", "Dest")
}

#: The same for tables that requests are served from, which know two more spellings.
SERVING_STATE_CANDIDATES = {
    side: [f"{side}State", f"{side.upper()}_STATE_ABR", f"{side}_State", f"{side}StateAbbr", f"{side}StateName", f"{side.upper()}_STATE_NM"] for side in ("Origin", "Dest")
}


def missing(columns: list[str], required: list[str] = FEATURES) -> list[str]:
    """Required columns that a frame does not have."""
    return [c for c in required if c not in columns]


def out_of_order(columns: list[str], required: list[str] = FEATURES) -> list[tuple[int, str]]:
    """(place, column) of the required columns that a frame does not have at their place."""
    return [(i, c) for i, c in enumerate(required) if i >= len(columns) or columns[i] != c]

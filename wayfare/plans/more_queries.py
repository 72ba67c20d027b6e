"""Queries of exploring, recommending, metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.functions import flight
from wayfare.operators import clean, explore, features, metadata, metrics, recommend, stats
from wayfare.plans import views as v
from wayfare.plans.base_queries import META_SQL, PAIRS_SQL, STATES_SQL, features_sql, meta_of, rounded, sql
from wayfare.plans.registry import query
from wayfare.sources import ontime, reports
from wayfare.sources.tables import new_path, small, written

_M = "count(*) as Flights, avg(ArrDel15) as DelayRate, avg(Cancelled) as CancelRate"
_PCT = "DelayRate * 100 as DelayRatePct, CancelRate * 100 as CancelRatePct"
_RATES = "DelayRate CancelRate DelayRatePct CancelRatePct"

# -- explore ------------------------------------------------------------------------------------------------------------
_HOURS = f"hours as (select *, {_PCT} from (select DepHour, {_M} from clean where ArrDel15 is not null group by 1) where Flights >= 200 and (select count(*) from clean where ArrDel15 is not null) >= 400)"
query("a23_hourly_risk", sql(f"{v.CLEAN_SQL}, {_HOURS}", "select * from hours", _RATES))(lambda s, d: rounded(explore.hourly_risk(v.cleaned(s, d), 200)))
query("a24_hour_month_matrix", sql(v.CLEAN_SQL, "select Month, DepHour, avg(ArrDel15) as DelayRate from clean where ArrDel15 is not null group by 1, 2", "DelayRate"))(
    lambda s, d: rounded(explore.hour_month_matrix(v.cleaned(s, d)))
)
_TOP = "(select '{k}' as kind, row_number() over (order by {c} {o}, DepHour) as place, DepHour, {c} as rate from hours order by {c} {o}, DepHour limit 3)"
query("t1k_hour_lists", sql(f"{v.CLEAN_SQL}, {_HOURS}", "select kind, cast(place as int) as place, DepHour, rate from (" + " union all ".join(_TOP.format(k=k, c=c, o=o) for k, c, o in (("worst_delay", "DelayRate", "desc"), ("best_delay", "DelayRate", "asc"), ("worst_cancel", "CancelRate", "desc"))) + ")", "rate"))(
    lambda s, d: rounded(explore.hour_lists(written(explore.hourly_risk(v.cleaned(s, d), 200))))
)
query("p18_context_lines", f"with {v.CLEAN_SQL}, {_HOURS} select DepHour, format('{{:02d}}:00 has {{:.1f}}% delays and {{:.2f}}% cancellations in {{:d}} trips', DepHour, DelayRatePct, CancelRatePct, Flights) as line from hours")(
    lambda s, d: explore.hourly_risk(v.cleaned(s, d), 200).select("DepHour", explore.context_line().alias("line"))
)
_BY_AIRLINE = f"by_airline as (select Reporting_Airline, {_M} from clean where Origin = 'NATION_3' and Dest = 'NATION_7' group by 1)"
_CHOSEN = "chosen as (select * from by_airline where case when (select max(Flights) from by_airline) >= {n} then Flights >= {n} else true end)"
for _n, _name in ((15, "a25_airlines_on_route"), (100_000, "a25_airlines_busiest")):
    query(_name, sql(f"{v.CLEAN_SQL}, {_BY_AIRLINE}, {_CHOSEN.format(n=_n)}", f"select *, {_PCT} from chosen", _RATES))(
        lambda s, d, n=_n: rounded(explore.airlines_on_route(v.cleaned(s, d), "NATION_3", "NATION_7", n))
    )
query("a26_route_summary", sql(v.CLEAN_SQL, "select avg(case when Cancelled = 0 then ArrDel15 end) as DelayRate, avg(Cancelled) as CancelRate, count(*) as Flights from clean where Origin = 'NATION_3' and Dest = 'NATION_7'", "DelayRate CancelRate"))(
    lambda s, d: rounded(explore.route_summary(v.cleaned(s, d), "NATION_3", "NATION_7"))
)
query("a27_best_airlines", f"with {v.CLEAN_SQL}, {_BY_AIRLINE} select (select Reporting_Airline from by_airline order by DelayRate, Reporting_Airline limit 1) as best_delay, (select Reporting_Airline from by_airline order by CancelRate, Reporting_Airline limit 1) as best_cancel")(
    lambda s, d: explore.best_airlines(explore.airlines_on_route(v.cleaned(s, d), "NATION_3", "NATION_7", 1))
)
_RANK = f"select *, {_PCT} from (select {{side}} as airport, {_M} from clean where ArrDel15 is not null {{more}} group by 1) where Flights >= {{least}} order by {{metric}} {{o}}, airport limit {{n}}"
query("a28_t2k_airport_ranking", sql(v.CLEAN_SQL, _RANK.format(side="Origin", more="", least=500, metric="DelayRate", o="desc", n=10), _RATES))(lambda s, d: rounded(explore.airport_ranking(v.cleaned(s, d))))
query("a28_focus_ranking", sql(v.CLEAN_SQL, _RANK.format(side="Dest", more="and Origin = 'NATION_4'", least=20, metric="CancelRate", o="asc", n=1000), _RATES))(
    lambda s, d: rounded(explore.airport_ranking(v.cleaned(s, d), "CancelRate", "Dest", "NATION_4", 20, None, False))
)
_DIRECT = "direct as (select Origin, Dest, Reporting_Airline, count(*) as Flights, avg(ArrDel15) as DelayRate, avg(Cancelled) as CancelRate, avg(ArrDel15) + 3.0::double * avg(Cancelled) as CombinedRisk from clean where ArrDel15 is not null and OriginState = '{a}' and DestState = '{b}' group by 1, 2, 3 having count(*) >= {n} order by CombinedRisk, Flights desc, Origin, Dest, Reporting_Airline limit 5)"
query("a29_t3k_state_direct", sql(f"{v.CLEAN_SQL}, {_DIRECT.format(a='ASIA', b='EUROPE', n=20)}", "select * from direct", "DelayRate CancelRate CombinedRisk"))(
    lambda s, d: rounded(explore.state_direct(v.cleaned(s, d), "ASIA", "EUROPE", 20))
)
query("a30_simple_routes", sql(v.CLEAN_SQL, f"select Origin, Dest, {_M} from clean group by 1, 2", "DelayRate CancelRate"))(lambda s, d: rounded(explore.simple_routes(v.cleaned(s, d))))

# -- recommend ----------------------------------------------------------------------------------------------------------
SCORE_SQL = "(RouteDelayRate * 3 + AirlineDelayRate + Origin_BadWeather * 0.1::double + abs(DepHour - 15) * 0.01::double + OriginSlotFlights * 0.001::double)"


def expression_score(df: DataFrame) -> DataFrame:
    """A fixed score for checks without a model."""
    c = F.col
    return df.withColumn("p", c("RouteDelayRate") * 3 + c("AirlineDelayRate") + c("Origin_BadWeather") * 0.1 + F.abs(c("DepHour") - 15) * 0.01 + c("OriginSlotFlights") * 0.001)


def _some_requests(s, d) -> DataFrame:
    return v.requests(v.flown(s, d))


_REASONS = """list_filter([case when Month in (11, 12, 1) then 'holiday_season' when Month in (6, 7, 8) then 'summer_peak' end,
  case when DayOfWeek in (6, 7) then 'weekend' end,
  case when RouteFlights > 0 and RouteDelayRate > gd + 0.03::double then 'route_delay_high' when RouteFlights > 0 and RouteDelayRate < gd - 0.03::double then 'route_delay_low' end,
  case when RouteFlights > 0 and RouteCancelRate > gc + 0.002::double then 'route_cancel_high' end,
  case when AirlineFlights > 0 and AirlineDelayRate > gd + 0.03::double then 'airline_delay_high' when AirlineFlights > 0 and AirlineDelayRate < gd - 0.03::double then 'airline_delay_low' end,
  case when AirlineFlights > 0 and AirlineCancelRate > gc + 0.002::double then 'airline_cancel_high' end,
  case when OriginSlotFlights > gs * 1.3::double then 'slot_busy' when OriginSlotFlights < gs * 0.7::double then 'slot_quiet' end,
  case when Origin_BadWeather > 0.35::double or Dest_BadWeather > 0.35::double then 'bad_weather' end], lambda x: x is not null)"""
query("r1_explain", f"with {META_SQL}, {v.REQUESTS_SQL}, {features_sql('requests')} select request_id, array_to_string({_REASONS}, ',') as reasons from (select built.*, g.global_delay_rate as gd, g.global_cancel_rate as gc, g.global_slot_mean as gs from built cross join defaults g)")(
    lambda s, d: (lambda meta: recommend.explain(features.build_features(_some_requests(s, d), meta), meta.defaults).select("request_id", F.concat_ws(",", "reasons").alias("reasons")))(meta_of(s, d))
)
_OTHER_HOURS = "other as (select * exclude (DepHour), cast(h as int) as DepHour, DepHour as own from requests, range(24) t(h))"
_SAFER_SQL = sql(f"{META_SQL}, {v.REQUESTS_SQL}, {_OTHER_HOURS}, {features_sql('other')}", f"select request_id, cast(place as int) as place, DepHour, p from (select *, row_number() over (partition by request_id order by round(p, 9), DepHour) as place from (select request_id, DepHour, {SCORE_SQL} as p from built where DepHour <> own)) where place <= 3", "p")


@query("r2_safer_hours", _SAFER_SQL)
@query("r2_safer_hours_all", _SAFER_SQL)
def safer_hours(spark, sf_dir):
    """For all requests; scores equal to nine digits are ties."""
    meta = meta_of(spark, sf_dir)
    return recommend.safer_hours(_some_requests(spark, sf_dir), meta, lambda x: expression_score(x).withColumn("p", F.round("p", 9)))


_OTHER_AIRLINES = "other as (select r.* exclude (Reporting_Airline), m.Reporting_Airline, r.Reporting_Airline as own from requests r join m9 m on m.Origin = r.Origin and m.Dest = r.Dest where m.RouteFlights > 0)"
query("r3_safer_airlines", sql(f"{META_SQL}, {v.REQUESTS_SQL}, {_OTHER_AIRLINES}, {features_sql('other')}", f"select request_id, cast(place as int) as place, Reporting_Airline, p from (select *, row_number() over (partition by request_id order by round(p, 9), Reporting_Airline) as place from (select request_id, Reporting_Airline, {SCORE_SQL} as p from built where Reporting_Airline <> own)) where place <= 3", "p"))(
    lambda s, d: (lambda meta: recommend.safer_airlines(_some_requests(s, d), meta, lambda x: expression_score(x).withColumn("p", F.round("p", 9))))(meta_of(s, d))
)
_ALT = """select request_id, '{s}' as side, cast(place as int) as place, alternative, Flights, DelayRate, CancelRate from (select r.request_id, n.airport as alternative, p.Flights, p.DelayRate, p.CancelRate,
  row_number() over (partition by r.request_id order by p.DelayRate + 3 * p.CancelRate, p.Flights desc, n.airport) as place
  from requests r join states h on h.airport = r.{s} join states n on n.state = h.state and n.airport <> r.{s} join pairs p on p.{s} = n.airport and p.{o} = r.{o} where p.Flights >= 80) where place <= 3"""
query("r4_alternative_airports", sql(f"{v.CLEAN_SQL}, {PAIRS_SQL}, {STATES_SQL}, {v.REQUESTS_SQL}", f"{_ALT.format(s='Origin', o='Dest')} union all {_ALT.format(s='Dest', o='Origin')}", "DelayRate CancelRate"))(
    lambda s, d: (lambda rows: rounded(recommend.alternative_airports(v.requests(rows), metadata.route_pair_meta(rows), metadata.airport_states(rows), least=80)))(
        written(v.cleaned(s, d).select("Reporting_Airline", "Origin", "Dest", "OriginState", "DestState", "DepHour", "FlightDate", "Distance", "ArrDel15", "Cancelled"))
    )
)
_LEGS = """legs as (select a.Origin, a.Dest as Hub, b.Dest, a.Flights as Flights_out, b.Flights as Flights_in, a.DelayRate + b.DelayRate as CombinedDelay, a.CancelRate + b.CancelRate as CombinedCancel,
  a.DelayRate + b.DelayRate + 3.0::double * (a.CancelRate + b.CancelRate) as RiskScore, a.Distance + b.Distance as TotalDistance, least(a.Flights, b.Flights) as MinFlights
  from pairs a join pairs b on a.Dest = b.Origin where least(a.Flights, b.Flights) >= {n} and a.Dest <> a.Origin and a.Dest <> b.Dest)"""
query("r5_j12_one_stop", sql(f"{v.CLEAN_SQL}, {PAIRS_SQL}, {_LEGS.format(n=80)}, asked as (select distinct Origin || '>' || Dest as request_id, Origin, Dest from clean)", """select request_id, cast(place as int) as place, Origin, Hub, Dest, Flights_out, Flights_in, CombinedDelay, CombinedCancel from (select *, row_number() over (partition by request_id
  order by RiskScore, TotalDistance, MinFlights desc, Hub) as place from asked join legs using (Origin, Dest)) where place <= 3""", "CombinedDelay CombinedCancel"))(
    lambda s, d: (lambda rows: rounded(recommend.one_stop(rows.select(F.concat_ws(">", "Origin", "Dest").alias("request_id"), "Origin", "Dest").distinct(), metadata.route_pair_meta(rows), least=80)))(written(v.cleaned(s, d)))
)
_STOPS = "stops as (select * from legs where Origin in (select airport from states where state = '{a}') and Dest in (select airport from states where state = '{b}') order by RiskScore, MinFlights desc, Origin, Hub, Dest limit 5)"
_R6 = """select 'direct' as kind, Origin, cast(null as varchar) as Hub, Dest, Reporting_Airline, CombinedRisk as Risk from direct
  union all select 'one_stop', Origin, Hub, Dest, null, RiskScore from stops where not exists (select 1 from direct)"""
for _n, _name in ((20, "r6_state_direct"), (85, "r6_j13_state_one_stop")):
    query(_name, sql(f"{v.CLEAN_SQL}, {PAIRS_SQL}, {STATES_SQL}, {_DIRECT.format(a='ASIA', b='EUROPE', n=_n)}, {_LEGS.format(n=_n)}, {_STOPS.format(a='ASIA', b='EUROPE')}", _R6, "Risk"))(
        lambda s, d, n=_n: (lambda rows: rounded(recommend.state_recommendation(rows, metadata.airport_states(rows), "ASIA", "EUROPE", n)))(written(v.cleaned(s, d)))
    )
query("r7_thin_history", f"""with {META_SQL}, {v.REQUESTS_SQL}, others as (select request_id, string_agg(o, ',' order by k) as richer from (select r.request_id, m.Reporting_Airline as o,
  row_number() over (partition by r.request_id order by round(m.RouteDelayRate + 3 * m.RouteCancelRate, 9), m.Reporting_Airline) as k from requests r join m9 m on m.Origin = r.Origin and m.Dest = r.Dest
  and m.Reporting_Airline <> r.Reporting_Airline where m.RouteFlights >= 10) where k <= 5 group by 1)
  select request_id, history, case when history = 'enough' then '' else coalesce(richer, '') end as richer from (select r.request_id,
  case when coalesce(RouteFlights, 0) = 0 then 'none' when RouteFlights < 10 then 'thin' else 'enough' end as history from requests r left join m9 using (Reporting_Airline, Origin, Dest)) left join others using (request_id)""")(
    lambda s, d: (lambda routes: recommend.thin_history(_some_requests(s, d), routes, least=10))(small(v.lattice(s, d, False).means(stats.ROUTE, ["RouteDelayRate", "RouteCancelRate", "RouteFlights"])))
)
query("p16_round_trip", sql(v.CLEAN_SQL + f", {PAIRS_SQL}", "select a.Origin || '>' || a.Dest as request_id, 1 - (1 - a.DelayRate) * (1 - b.DelayRate) as p_delay, 1 - (1 - a.CancelRate) * (1 - b.CancelRate) as p_cancel from pairs a join pairs b on a.Origin = b.Dest and a.Dest = b.Origin", "p_delay p_cancel"))(
    lambda s, d: (lambda pairs: rounded(recommend.round_trip(
        pairs.select(F.concat_ws(">", "Origin", "Dest").alias("request_id"), F.col("DelayRate").alias("p_delay"), F.col("CancelRate").alias("p_cancel")),
        pairs.select(F.concat_ws(">", "Dest", "Origin").alias("request_id"), F.col("DelayRate").alias("p_delay"), F.col("CancelRate").alias("p_cancel")),
    )))(written(metadata.route_pair_meta(v.cleaned(s, d))))
)

# -- metrics ------------------------------------------------------------------------------------------------------------
# by score: rows of each class with it, under it, and in all
_CUM = """{v}, g as (select {k} p, cast(sum(label) as double) as pos, cast(count(*) - sum(label) as double) as neg from {t} group by all),
c as (select *, coalesce(sum(pos) over ({w} order by p rows between unbounded preceding and 1 preceding), 0) as posb, coalesce(sum(neg) over ({w} order by p rows between unbounded preceding and 1 preceding), 0) as negb,
  sum(pos) over ({w}) as P, sum(neg) over ({w}) as N from g)"""
_CUM_ALL = _CUM.format(v=v.SCORED_SQL, k="", t="scored", w="")
_AUC = "sum(pos * (negb + neg / 2)) / nullif(max(P * N), 0)"
_AP = "sum(pos * (P - posb) / ((P - posb) + (N - negb))) / nullif(max(P), 0)"
# DuckDB's names are not case sensitive, so P and p would clash
_fix = lambda text: text.replace("as P,", "as pall,").replace("as N from", "as nall from").replace("P * N", "pall * nall").replace("(P -", "(pall -").replace("(N -", "(nall -").replace("max(P)", "max(pall)")
_CUM, _CUM_ALL, _AUC, _AP = _fix(_CUM), _fix(_CUM_ALL), _fix(_AUC), _fix(_AP)
query("e1_e2_ranking", sql(_CUM_ALL, f"select {_AUC} as roc_auc, {_AP} as pr_auc from c", "roc_auc pr_auc"))(lambda s, d: rounded(metrics.ranking(v.scored(s, d))))
query("e3_brier", sql(v.SCORED_SQL, "select avg((p - label) * (p - label)) as brier from scored", "brier"))(lambda s, d: rounded(metrics.brier(v.scored(s, d))))
_C4 = "c4 as (select count(*) filter (p >= {t} and label = 1) as tp, count(*) filter (p >= {t} and label = 0) as fp, count(*) filter (p < {t} and label = 1) as fn, count(*) filter (p < {t} and label = 0) as tn from scored)"
query("e4_threshold", sql(f"{v.SCORED_SQL}, {_C4.format(t='0.4::double')}", "select (tp + tn) / (tp + fp + fn + tn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision_pos, coalesce(tp / nullif(tp + fn, 0), 0) as recall_pos, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_pos from c4", "accuracy precision_pos recall_pos f1_pos"))(
    lambda s, d: rounded(metrics.at_threshold(v.scored(s, d), 0.4))
)
_TWO = "two as (select '0' as class, tn / (tn + fn) as precision, tn / (tn + fp) as recall, 2 * tn / (2 * tn + fn + fp) as f1, tn + fp as support from c4 union all select '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn from c4)"
query("e5_class_report", sql(f"{v.SCORED_SQL}, {_C4.format(t='0.4::double')}, {_TWO}", "select * from two union all select 'macro', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from two union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) as bigint) from two", "precision recall f1"))(
    lambda s, d: rounded(metrics.classification_report(v.scored(s, d), 0.4))
)
query("e6_confusion", f"with {v.SCORED_SQL} select label, case when p >= 0.4::double then 1 else 0 end as pred, count(*) as n from scored group by 1, 2")(lambda s, d: metrics.confusion(v.scored(s, d), 0.4))
query("e7_e12_top_bucket", sql(f"{v.SCORED_SQL}, q as (select quantile_cont(p, 0.9) as t from scored)", "select avg(label) filter (p >= t) as top_rate, avg(label) filter (p < t) as rest_rate, sum(label) filter (p >= t) / sum(label) as event_share from scored, q", "top_rate rest_rate event_share"))(
    lambda s, d: rounded(metrics.top_bucket(written(v.scored(s, d)), 0.9))
)
query("e8_roc_curve", sql(_CUM_ALL, "select p as threshold, (nall - negb) / nall as fpr, (pall - posb) / pall as tpr from c", "threshold fpr tpr"))(lambda s, d: rounded(metrics.roc_curve(v.scored(s, d))))
query("e9_pr_curve", sql(_CUM_ALL, "select p as threshold, (pall - posb) / ((pall - posb) + (nall - negb)) as precision, (pall - posb) / pall as recall, pall / (pall + nall) as prevalence from c", "threshold precision recall prevalence"))(
    lambda s, d: rounded(metrics.pr_curve(v.scored(s, d)))
)
_EDGES = "[" + ", ".join(str(i / 20) for i in range(1, 20)) + "]"
query("e10_calibration", sql(f"{v.SCORED_SQL}, q as (select quantile_cont(p, {_EDGES}) as e from scored)", "select cast(len(list_filter(e, lambda x: x < p)) as int) as bin, avg(p) as mean_p, avg(label) as rate, count(*) as n from scored, q group by 1", "mean_p rate"))(
    lambda s, d: rounded(metrics.calibration(written(v.scored(s, d))))
)
query("e11_histogram", sql(f"{v.SCORED_SQL}, ends as (select label, min(p) as lo, max(p) as hi, count(*) as n from scored group by 1)", "select label, bin, count(*) as n, count(*) / (max(en) * max(w)) as density from (select label, cast(least(29, floor((p - lo) / ((hi - lo) / 30))) as int) as bin, e.n as en, (hi - lo) / 30 as w from scored join ends e using (label)) group by 1, 2", "density"))(
    lambda s, d: rounded(metrics.histogram(v.scored(s, d)))
)
_BEST = "select threshold, f1 from (select i / 100 as threshold, coalesce(2 * count(*) filter (p >= i / 100 and label = 1) / nullif(count(*) filter (p >= i / 100) + count(*) filter (label = 1), 0), 0) as f1 from scored, range(1, 100) t(i) group by i) order by f1 desc, threshold limit 1"
query("e13_best_threshold", sql(v.SCORED_SQL, _BEST, "f1"))(lambda s, d: rounded(metrics.best_threshold(v.scored(s, d))))
query("e14_core_metrics", sql(f"{_CUM_ALL}, q as (select quantile_cont(p, 0.9) as t from scored)", f"select (select count(*) from scored) as n, (select avg(label) from scored) as base_rate, (select {_AUC} from c) as roc_auc, (select {_AP} from c) as pr_auc, (select avg((p - label) * (p - label)) from scored) as brier, (select avg(label) filter (p >= t) from scored, q) as top_rate, (select sum(label) filter (p >= t) / sum(label) from scored, q) as event_share", "base_rate roc_auc pr_auc brier top_rate event_share"))(
    lambda s, d: rounded(metrics.core(written(v.scored(s, d))))
)
query("e15_stratification", sql(f"{v.SCORED_SQL}, f as (select unnest([0.05::double, 0.1, 0.2, 0.3, 0.5]) as share), q as (select share, (select quantile_cont(p, 0.95) from scored) as t from f where share = 0.05 union all select share, (select quantile_cont(p, 0.9) from scored) from f where share = 0.1 union all select share, (select quantile_cont(p, 0.8) from scored) from f where share = 0.2 union all select share, (select quantile_cont(p, 0.7) from scored) from f where share = 0.3 union all select share, (select quantile_cont(p, 0.5) from scored) from f where share = 0.5)",
  "select share, count(*) filter (p >= t) as n, avg(label) filter (p >= t) as event_rate, avg(label) filter (p >= t) / avg(label) as uplift, sum(label) filter (p >= t) / sum(label) as event_share from scored, q group by share", "event_rate uplift event_share"))(
    lambda s, d: rounded(metrics.stratification(written(v.scored(s, d))))
)
_BY = lambda key: _CUM.format(v=v.SCORED_SQL, k=f"{key},", t="scored", w=f"partition by {key}")
query("e16_by_group", sql(_BY("Reporting_Airline"), f"select Reporting_Airline, n_samples, auc, brier, prevalence from (select Reporting_Airline, count(*) as n_samples, avg((p - label) * (p - label)) as brier, avg(label) as prevalence from scored group by 1 having count(*) >= 1000) join (select Reporting_Airline, {_AUC} as auc from c group by 1) using (Reporting_Airline)", "auc brier prevalence"))(
    lambda s, d: rounded(metrics.by_group(written(v.scored(s, d)), "Reporting_Airline"))
)
query("e17_t4k_drift", sql(_BY("Year"), f"select Year, AUC, Brier from (select Year, avg((p - label) * (p - label)) as Brier from scored group by 1) join (select Year, {_AUC} as AUC from c group by 1) using (Year) where AUC is not null", "AUC Brier"))(
    lambda s, d: rounded(metrics.drift(written(v.scored(s, d))))
)
query("e18_bootstrap")(lambda s, d: metrics.bootstrap_difference(written(v.scored(s, d)), "brier"))
query("e18_bootstrap_auc")(lambda s, d: metrics.bootstrap_difference(written(v.scored(s, d)), "roc_auc"))


def _two_models(s, d) -> DataFrame:
    rows = v.scored(s, d).withColumn("split", F.when(F.col("Year") == 1999, "val").when(F.col("Year") >= 2000, "test")).filter("split is not null")
    one = lambda name, p: rows.select(F.lit(name).alias("model"), "split", "label", F.col(p).alias("p"))
    return one("score", "p_a").unionByName(one("hour", "p_b"))


_MODELS = f"""{v.SCORED_SQL}, models as (select 'score' as model, case when Year = 1999 then 'val' else 'test' end as split, label, p_a as p from scored where Year >= 1999
  union all select 'hour', case when Year = 1999 then 'val' else 'test' end, label, p_b from scored where Year >= 1999), tests as (select * from models where split = 'test')"""
_MODELS_CUM = _CUM.format(v=_MODELS, k="model,", t="tests", w="partition by model")
query("e19_compare_models", sql(f"""{_MODELS_CUM}, f as (select model, i / 100 as threshold, coalesce(2 * count(*) filter (p >= i / 100 and label = 1) / nullif(count(*) filter (p >= i / 100) + count(*) filter (label = 1), 0), 0) as f1_val from models, range(1, 100) t(i) where split = 'val' group by model, i),
best as (select model, threshold, f1_val from (select *, row_number() over (partition by model order by f1_val desc, threshold) as k from f) where k = 1)""",
  f"select model, roc_auc, pr_auc, brier, threshold, f1_val, f1_test from (select model, {_AUC} as roc_auc, {_AP} as pr_auc from c group by 1) join (select model, avg((p - label) * (p - label)) as brier from tests group by 1) using (model) join best using (model) join (select model, 2 * count(*) filter (p >= threshold and label = 1) / (count(*) filter (p >= threshold) + count(*) filter (label = 1)) as f1_test from tests join best using (model) group by 1) using (model)", "roc_auc pr_auc brier f1_val f1_test"))(
    lambda s, d: rounded(metrics.compare_models(written(_two_models(s, d))))
)
query("e20_metric_rows", sql(v.SCORED_SQL, "select 'all' as context, cast(null as int) as Year, avg((p - label) * (p - label)) as brier from scored union all select 'year', Year, avg((p - label) * (p - label)) from scored group by Year", "brier"))(
    lambda s, d: rounded(metrics.brier(v.scored(s, d)).select(F.lit("all").alias("context"), F.lit(None).cast("int").alias("Year"), "brier").unionByName(
        metrics.brier(v.scored(s, d), ["Year"]).select(F.lit("year").alias("context"), "Year", "brier")
    ))
)
_ROWS_CUM = _CUM.format(v=_MODELS, k="model, split,", t="models", w="partition by model, split")
_ROWS_SQL = f"""{_ROWS_CUM}, areas as (select model, split, {_AUC} as roc_auc, {_AP} as pr_auc from c group by 1, 2),
cuts as (select model, split, quantile_cont(p, 0.9) as t from models group by 1, 2),
sums as (select model, split, avg((p - label) * (p - label)) as brier, avg(label) filter (p >= t) as top, count(*) as n, count(*) filter (p >= 0.4::double and label = 1) as tp,
  count(*) filter (p >= 0.4::double) as up, count(*) filter (label = 1) as pos, count(*) filter ((p >= 0.4::double) = (label = 1)) as good from models join cuts using (model, split) group by 1, 2),
met as (select model as context, split, 0.4::double as threshold, roc_auc, pr_auc, brier, case when model = 'score' then top end as top_bucket_rate, case when model = 'score' then 0.9::double end as top_bucket_quantile,
  good / n as accuracy, coalesce(tp / nullif(up, 0), 0) as precision_pos, coalesce(tp / nullif(pos, 0), 0) as recall_pos, coalesce(2 * tp / nullif(up + pos, 0), 0) as f1_pos from areas join sums using (model, split))"""


def _metric_table(s, d) -> DataFrame:
    """Rows of two models on two splits; the top bucket is asked of one model."""
    rows = written(_two_models(s, d))
    of = lambda model, split: rows.filter((F.col("model") == model) & (F.col("split") == split))
    tops = {"score": 0.9, "hour": None}
    return reduce(DataFrame.unionByName, [metrics.metric_row(of(m, x), m, x, 0.4, top) for m, top in tops.items() for x in ("val", "test")])


query("e20_metric_table", sql(_ROWS_SQL, "select * from met", "roc_auc pr_auc brier top_bucket_rate accuracy precision_pos recall_pos f1_pos"))(lambda s, d: rounded(_metric_table(s, d)))
query("e23_quality", f"with {v.SCORED_SQL} select 'p' as \"check\", count(*) filter (p is null) as bad from scored union all select 'p_b', count(*) filter (p_b is null) from scored union all select 'p outside 0..1', count(*) filter (p < 0 or p > 1) from scored")(
    lambda s, d: metrics.quality(v.scored(s, d), ["p", "p_b"], "p")
)
@query(
    "e23_observed",
    f"""with {v.PREPARED_SQL} select 'rows' as "check", count(*) as n from prepared union all select 'Distance', count(*) filter (Distance is null) from prepared
  union all select 'ArrDel15', count(*) filter (ArrDel15 is null) from prepared union all select 'RouteDelayRate outside 0..1', count(*) filter (RouteDelayRate not between 0 and 1) from prepared
  union all select 'missing columns', 0::bigint union all select 'columns out of place', 0::bigint""",
)
def observed(spark, sf_dir):
    """Checks of the prepared trips, counted while they are written in the order of the feature contract."""
    rows = v.prepared(spark, sf_dir).select(*schema.FEATURES, "ArrDel15")
    return reports.write_observed(rows, ["Distance", "ArrDel15"], {"RouteDelayRate": (0.0, 1.0)}, schema.FEATURES)[1]


query("l6_class_weights", sql(v.SCORED_SQL, "select 1.0::double as w0, count(*) filter (label = 0) / count(*) filter (label = 1) as w1 from scored", "w0 w1"))(lambda s, d: rounded(metrics.class_weights(v.scored(s, d), "label")))
query("l8_ensemble_weight", sql(v.SCORED_SQL, "select weight, brier from (select w as weight, avg((w * p_a + (1 - w) * p_b - label) * (w * p_a + (1 - w) * p_b - label)) as brier from scored, (select unnest([0.3::double, 0.5, 0.7]) as w) group by 1) order by brier, weight limit 1", "brier"))(
    lambda s, d: rounded(metrics.ensemble_weight(v.scored(s, d)))
)
query("l10_two_classes", f"with {v.SCORED_SQL} select Year, count(distinct label) = 2 as trainable from scored group by 1")(lambda s, d: metrics.two_classes(v.scored(s, d), "label", ["Year"]))

# -- sinks, read back ---------------------------------------------------------------------------------------------------
query("s8_parquet_sink", f"with {v.CLEAN_SQL} select Year, count(*) as n from clean group by 1")(
    lambda s, d: reports.write_partitioned(v.cleaned(s, d), "Year").groupBy("Year").agg(F.count("*").alias("n"))
)
@query("s8_rerun_one_year", f"with {v.CLEAN_SQL} select Year, count(*) as n, sum(Distance) as Distance from clean where Year <> 1997 or Cancelled = 1 group by 1")
def rerun_one_year(spark, sf_dir):
    """Trips by year, of which one year is written again with its cancelled trips alone; the others stay as they were."""
    rows = written(v.cleaned(spark, sf_dir))
    at = new_path(spark, "parquet")
    reports.write_partitioned(rows, "Year", at)
    again = reports.write_partitioned(rows.filter("Year = 1997 and Cancelled = 1"), "Year", at)
    return again.groupBy("Year").agg(F.count("*").alias("n"), F.sum("Distance").alias("Distance"))


query("s9_csv_report", sql(v.SCORED_SQL, "select Year, count(*) as n, round(avg((p - label) * (p - label)), 9) as brier from scored group by 1"))(
    lambda s, d: reports.write_csv(rounded(v.scored(s, d).groupBy("Year").agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("brier"))), "Year int, n bigint, brier double")
)
query("s10_text_report", f"with {v.SCORED_SQL} select format('{{:d}}: {{:d}} rows, base rate {{:.4f}}', cast(Year as bigint), count(*), avg(label)) as value from scored group by Year")(
    lambda s, d: reports.write_text(v.scored(s, d).groupBy("Year").agg(F.count("*").alias("n"), F.avg("label").alias("r")).select(F.format_string("%d: %d rows, base rate %.4f", "Year", "n", "r").alias("value")))
)
_F4 = lambda label, c: f"'{label}: ' || coalesce(format('{{:.4f}}', round({c}, 9)), 'N/A')"
_MET_LINES = ", ".join(["context || ' / ' || split", "'Threshold: ' || format('{:.3f}', threshold)", *(_F4(k, c) for k, c in reports.METRIC_LINES.items()),
    "case when top_bucket_quantile is not null then 'Top ' || cast(cast(round((1 - top_bucket_quantile) * 100) as int) as varchar) || '% bucket positive rate: ' || coalesce(format('{:.4f}', round(top_bucket_rate, 9)), 'N/A') end"])
query("s10_metric_report", f"with {_ROWS_SQL} select value from (select unnest([{_MET_LINES}]) as value from met) where value is not null")(
    lambda s, d: reports.write_text(reports.metric_lines(rounded(_metric_table(s, d))))
)
_TASKS = f"""{v.CLEAN_SQL}, tasks as (select 'ArrDel15' as task, cast(ArrDel15 as int) as label, score as p from clean where Year = 2001 and Cancelled = 0 and ArrDel15 is not null
  union all select 'Cancelled', cast(Cancelled as int), score from clean where Year = 2001 and Cancelled in (0, 1))"""
_TASKS_CUM = _CUM.format(v=_TASKS, k="task,", t="tasks", w="partition by task")
_BACK_SQL = f"""{_TASKS_CUM}, areas as (select task, {_AUC} as roc_auc, {_AP} as pr_auc from c group by 1), cuts as (select task, quantile_cont(p, 0.9) as t from tasks group by 1),
sums as (select task, count(*) as n, avg(label) as base_rate, avg((p - label) * (p - label)) as brier, avg(label) filter (p >= t) as top_rate, sum(label) filter (p >= t) / nullif(sum(label), 0) as event_share from tasks join cuts using (task) group by 1),
back as (select * from areas join sums using (task))"""
_BACK_LINES = ", ".join(["'Task: ' || task", "'Samples: ' || cast(n as varchar)", *(_F4(k, c) for k, c in reports.BACKTEST_LINES.items())])


@query("s10_backtest_summary", f"with {_BACK_SQL} select unnest([{_BACK_LINES}]) as value from back")
def backtest_summary(spark, sf_dir):
    """Summary of both tasks on the last year's trips, with the fixed score in the place of a model's."""
    rows = written(clean.year_guard(v.cleaned(spark, sf_dir), 2001))
    tasks = (("ArrDel15", clean.delay_labelled(rows)), ("Cancelled", clean.cancel_labelled(rows)))
    cores = [metrics.core(x.select(F.col(c).cast("int").alias("label"), F.col("score").alias("p"))).select(F.lit(c).alias("task"), "*") for c, x in tasks]
    return reports.write_text(reports.backtest_lines(rounded(cores[0].unionByName(cores[1]))))


query("s2_csv_scan", f"with {v.TRIPS_SQL} select FlightDate, Origin, Dest, CRSDepTime, Distance, ArrDel15, OriginState from raw")(
    lambda s, d: reports.csv_round_trip(v.trips(s, d).select("FlightDate", "Origin", "Dest", "CRSDepTime", "Distance", "ArrDel15", "OriginState"))
)
_CSV = ["FlightDate", "Origin", "Dest", "CRSDepTime", "Distance", "ArrDel15", "OriginState"]


@query("s2_mixed_headers", f"with {v.TRIPS_SQL} select {', '.join(_CSV)} from raw")
def mixed_headers(spark, sf_dir):
    """CSV files of two column orders, one of them with a column more, read together."""
    rows, at = v.trips(spark, sf_dir).select("Month", *_CSV), new_path(spark, "csv")
    odd = F.coalesce(F.col("Month") % 2 == 1, F.lit(False))
    rows.filter(odd).select("Month", *_CSV).write.csv(f"{at}/a", header=True)
    rows.filter(~odd).select(*reversed(_CSV)).write.csv(f"{at}/b", header=True)
    return ontime.read_csv(spark, f"{at}/*").select(*(F.col(c).cast(t).alias(c) for c, t in rows.select(*_CSV).dtypes))


_PARTS = "Month % 5 = 0"


def _archive_folder(spark, sf_dir) -> str:
    """Archives by year, month and quarter of the minutes; those of every fifth month are no archives."""
    at = new_path(spark, "archives")
    rows = v.trips(spark, sf_dir).select("Year", "Month", *_CSV, (F.col("CRSDepTime") % 4).alias("part"))
    ontime.write_archives(rows, at, ["Year", "Month", "part"])
    damaged = rows.filter(_PARTS).select(F.concat_ws("-", "Year", "Month", "part").alias("name")).distinct()
    ontime.cut_short(damaged, at)
    return at


@query("s1_archives", f"with {v.TRIPS_SQL} select Origin, Year, Month, CRSDepTime, count(*) as n, count(ArrDel15) as known, sum(Distance) as Distance from raw where not {_PARTS} group by 1, 2, 3, 4")
def archives(spark, sf_dir):
    """Trips written to archives and read again, only the columns that are asked for; damaged archives are left out."""
    columns = ["Origin", "Year", "Month", "CRSDepTime", "Distance", "ArrDel15"]
    rows = ontime.read_archives(spark, _archive_folder(spark, sf_dir), columns=columns)
    return rows.groupBy("Origin", "Year", "Month", "CRSDepTime").agg(F.count("*").alias("n"), F.count("ArrDel15").alias("known"), F.sum("Distance").alias("Distance"))


@query("s4_quarantine", f"with {v.TRIPS_SQL} select Year, count(distinct case when {_PARTS} then Month * 4 + CRSDepTime % 4 end) as damaged, count(*) filter (not {_PARTS}) as n from raw group by 1")
def quarantine(spark, sf_dir):
    """By year: archives that could not be read, and rows of the others."""
    rows = ontime.read_archives(spark, _archive_folder(spark, sf_dir), with_errors=True, columns=["Year"])
    year = F.coalesce("Year", F.regexp_extract("path", r"([0-9]+)-[0-9]+-[0-9]+[.]zip$", 1).cast("int"))
    return rows.groupBy(year.alias("Year")).agg(F.count_distinct(F.when(F.col("error").isNotNull(), F.col("path"))).alias("damaged"), F.count_if(F.col("error").isNull()).alias("n"))


@query("u1_union_by_name", f"with {v.TRIPS_SQL} select Year, count(*) as n, count(OriginState) filter (Year % 2 = 1) as states from raw group by 1")
def union_by_name(spark, sf_dir):
    """One frame for each year, of which even ones have no OriginState, put together by name."""
    rows = written(v.trips(spark, sf_dir))
    frames = [clean.year_guard(rows, y).drop(*(["OriginState"] if y % 2 == 0 else [])) for y in range(v.TRAIN[0], v.TEST[1] + 1)]
    return clean.union_frames(frames).groupBy("Year").agg(F.count("*").alias("n"), F.count("OriginState").alias("states"))


query("u3_distinct_states", f"with {v.TRIPS_SQL} select OriginState as state from raw union select DestState from raw")(
    lambda s, d: v.trips(s, d).select(F.col("OriginState").alias("state")).union(v.trips(s, d).select("DestState")).distinct()
)
query("j14_hour_candidates", f"with {v.CLEAN_SQL}, {v.REQUESTS_SQL} select request_id, cast(h as int) as hour from requests, range(24) t(h)")(
    lambda s, d: _some_requests(s, d).select("request_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
)
query("t3k_combined_top", sql(v.CLEAN_SQL, "select Origin, Dest, avg(ArrDel15) + 3.0::double * avg(Cancelled) as CombinedRisk, count(*) as Flights from clean group by 1, 2 order by CombinedRisk, Flights desc, Origin, Dest limit 20", "CombinedRisk"))(
    lambda s, d: rounded(explore.simple_routes(v.cleaned(s, d)).select("Origin", "Dest", flight.combined_risk().alias("CombinedRisk"), "Flights").orderBy("CombinedRisk", F.desc("Flights"), "Origin", "Dest").limit(20))
)

"""Edge cases of the trip operators on hand-made tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.functions import calendar, flight
from wayfare.operators import clean, explore, metadata, metrics, recommend, sampling, stats, weather
from wayfare.sources import ontime

RAW = "Year int, Month int, DayOfWeek int, FlightDate string, Reporting_Airline string, Origin string, Dest string, CRSDepTime int, Distance double, Cancelled int, Diverted int, ArrDel15 double"
OK = (2010, 3, 1, "2010-03-01", "AA", "X", "Y", 905, 600.0, 0, 0, 1.0)


def raw(spark, *changes):
    names = [f.split()[0] for f in RAW.split(", ")]
    return spark.createDataFrame([tuple((dict(zip(names, OK)) | c).values()) for c in changes], RAW)


def test_cleaning_rules(spark):
    df = raw(spark, {}, {"Origin": None}, {"Diverted": None}, {"Diverted": 1}, {"FlightDate": "no date"}, {"CRSDepTime": 2400}, {"ArrDel15": None}, {"ArrDel15": float("nan")})
    rows = clean.clean(df).collect()
    assert len(rows) == 5
    assert sorted(r.DepHour for r in rows) == [0, 9, 9, 9, 9]
    assert sum(r.ArrDel15 is None for r in rows) == 2
    assert all(r.OriginState is None for r in rows)


@pytest.mark.parametrize("miles, band", [(499.9, "short"), (500.0, "medium"), (1499.9, "medium"), (1500.0, "long"), (2999.9, "long"), (3000.0, "ultra_long")])
def test_distance_bands(spark, miles, band):
    assert spark.range(1).select(flight.distance_band(F.lit(miles)).alias("b")).first().b == band


def test_calendars(spark):
    days = ["2010-12-31", "2011-01-01", "2021-06-18", "2021-12-24", "2022-06-20", "2020-06-19", "2022-11-24", "2022-11-23", "2022-11-25", "2022-12-31"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "FlightDate date")
    seen = {str(r.FlightDate): r for r in calendar.add_observed_flags(df).collect()}
    assert [d for d in days if seen[d].IsHoliday] == ["2010-12-31", "2021-06-18", "2021-12-24", "2022-06-20", "2022-11-24"]
    assert seen["2022-11-23"].IsDayBeforeHoliday and seen["2022-11-25"].IsDayAfterHoliday and seen["2011-01-01"].IsDayAfterHoliday
    plain = {str(r.FlightDate): r for r in calendar.add_plain_flags(df).collect()}
    assert [d for d in days if plain[d].IsHoliday] == ["2011-01-01", "2022-11-24"]
    assert not plain["2022-12-31"].IsDayBeforeHoliday and plain["2021-12-24"].IsDayBeforeHoliday


def test_weather_edges(spark):
    wx = spark.createDataFrame([("X", dt.date(2010, 3, 1), 0.99, 0.0, 29.9), ("Y", dt.date(2010, 3, 1), 1.0, None, None)], "Airport string, time date, prcp double, snow double, wspd double")
    r = weather.attach_weather(clean.clean(raw(spark, {}, {"Origin": "Z"})), wx).collect()
    by = {x.Origin: x for x in r}
    assert by["X"].Origin_BadWeather == 0 and by["X"].Dest_BadWeather == 1
    assert by["X"].Origin_tavg == 15.0 and by["Z"].Origin_prcp == 0.0 and by["Z"].Origin_wspd == 29.9


def test_hubs_at_the_limits(spark):
    df = spark.createDataFrame([("X", "A")] * 4 + [("X", "B")] * 12 + [("Y", "A")] * 3, "Origin string, Reporting_Airline string")
    hub = {(r.Origin, r.Reporting_Airline): r.hub for r in stats.hubs(df, "Origin", "hub", 0.25, 4).collect()}
    assert hub == {("X", "A"): 1, ("X", "B"): 1, ("Y", "A"): 0}


def test_state_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("A", "B", "s2", None), ("A", "B", "s1", "t"), ("C", "A", None, "s9")], "Origin string, Dest string, OriginState string, DestState string")
    assert {r.airport: r.state for r in metadata.airport_states(df).collect()} == {"A": "s1", "B": "t"}


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).select((F.col("id") % 2 + 2000).cast("int").alias("Year"), (F.col("id") % 12 + 1).cast("int").alias("Month"), "id")
    a = {r.id for r in sampling.balanced(df, 120).collect()}
    assert a == {r.id for r in sampling.balanced(df.repartition(7), 120).collect()} and len(a) == 12 * 10
    lab = df.withColumn("label", (F.col("id") < 100).cast("int"))
    assert {r.label: r["count"] for r in sampling.negatives(lab, "label").groupBy("label").count().collect()} == {1: 100, 0: 270}
    assert sampling.negatives(lab.filter("label = 0"), "label").count() == 900
    assert sampling.take(df, 17).count() == 17


SCORED = "label int, p double, k string"


def test_metrics_with_ties_and_one_class(spark):
    rows = [(1, 0.5, "a"), (0, 0.5, "a"), (1, 1.0, "a"), (0, 0.0, "a"), (1, 0.3, "b"), (1, 0.2, "b")]
    r = {x.k: x for x in metrics.ranking(spark.createDataFrame(rows, SCORED), ["k"]).collect()}
    assert r["a"].roc_auc == 0.875 and r["b"].roc_auc is None and r["b"].pr_auc == 1.0
    assert math.isclose(r["a"].pr_auc, 0.5 * 1 + 0.5 * 2 / 3)
    none = spark.createDataFrame([], SCORED)
    assert metrics.ranking(none).first().roc_auc is None and metrics.at_threshold(none, 0.5).first().f1_pos == 0.0
    best = metrics.best_threshold(spark.createDataFrame(rows, SCORED)).first()
    assert best.threshold == 0.01 and math.isclose(best.f1, 8 / 9)
    assert metrics.top_bucket(spark.createDataFrame([(0, 0.1, "a"), (0, 0.2, "a")], SCORED)).first().event_share is None


def test_bootstrap_sign(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), F.lit(0.5).alias("p_a"), F.when(F.col("id") % 2 == 1, 0.9).otherwise(0.2).alias("p_b"))
    for metric in ("brier", "roc_auc"):
        r = metrics.bootstrap_difference(df, metric, 40).first()
        assert r.low > 0 and r.replicates == 40


def test_top_lists_and_fallbacks(spark):
    rows = [{"Reporting_Airline": a, "CRSDepTime": h * 100} for a, h, n in (("A", 1, 3), ("B", 2, 2)) for _ in range(n)]
    df = clean.clean(raw(spark, *rows))
    assert [r.Reporting_Airline for r in explore.airlines_on_route(df, "X", "Y", 3).collect()] == ["A"]
    assert {r.Reporting_Airline for r in explore.airlines_on_route(df, "X", "Y", 9).collect()} == {"A", "B"}
    assert explore.hourly_risk(df, 3).count() == 0 and explore.hourly_risk(df, 2).count() == 2
    best = explore.best_airlines(explore.airlines_on_route(df, "X", "Y", 1)).first()
    assert best.best_delay == "A"  # equal rates: by name


def test_one_stop_needs_a_real_hub(spark):
    pairs = spark.createDataFrame([("A", "B", 100.0, 200, 0.1, 0.0), ("B", "C", 100.0, 200, 0.1, 0.0), ("A", "A", 1.0, 500, 0.0, 0.0), ("A", "C", 1.0, 500, 0.0, 0.0), ("C", "C", 1.0, 500, 0.0, 0.0), ("A", "D", 1.0, 10, 0.0, 0.0), ("D", "C", 1.0, 900, 0.0, 0.0)],
        "Origin string, Dest string, Distance double, Flights long, DelayRate double, CancelRate double")
    asked = spark.createDataFrame([("q", "A", "C"), ("r", "C", "Z")], "request_id string, Origin string, Dest string")
    assert [(r.request_id, r.Hub) for r in recommend.one_stop(asked, pairs).collect()] == [("q", "B")]


def test_feature_contract():
    assert len(schema.FEATURES) == len(set(schema.FEATURES)) == 43
    assert set(schema.CALENDAR + schema.NETWORK + schema.WEATHER) | {"Reporting_Airline", "OriginState", "DestState"} == set(schema.FEATURES)
    # the order that the models are given, and the sizes of the ablation's sets
    assert schema.FEATURES[:14] == "Year Month DayOfWeek DayOfMonth DayOfYear DepHour IsWeekend IsHolidaySeason IsHoliday IsDayBeforeHoliday IsDayAfterHoliday Distance RouteDelayRate RouteCancelRate".split()
    assert schema.FEATURES[21:26] == "IsAirlineHubAtOrigin IsAirlineHubAtDest DepHour_sin DepHour_cos Origin_tavg".split()
    assert schema.FEATURES[35:] == "Reporting_Airline Origin Dest Route Season DistanceBand OriginState DestState".split()
    assert {k: len(x) for k, x in schema.ABLATION.items()} == {"calendar_only": 14, "route_airline_congestion_only": 16, "weather_only": 10, "all_features": 43, "no_weather": 33}
    assert schema.out_of_order(schema.FEATURES) == [] and schema.out_of_order(["Month", "Year"], ["Year", "Month"]) == [(0, "Year"), (1, "Month")]


def test_archives(spark, tmp_path):
    import zipfile

    header = ",".join(f.split()[0] for f in RAW.split(", ")) + ",ORIGIN_STATE_ABR,extra"
    line = ",".join(str(x) for x in OK) + ",TX,zzz"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.html", "no")
        z.writestr("month.csv", f"{header}\n{line}\n{line}\n")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "b.csv").write_text(f"{header}\n{line}\n")
    got = ontime.read_folder(spark, str(tmp_path))
    assert got.count() == 3 and set(schema.CORE) <= set(got.columns)
    rows = clean.clean(got).collect()
    assert len(rows) == 3 and {r.OriginState for r in rows} == {"TX"}
    bad = ontime.read_archives(spark, str(tmp_path / "*.zip"), with_errors=True).filter("error is not null").collect()
    assert len(bad) == 1 and bad[0].path.endswith("broken.zip")


def test_csv_files_of_other_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Year,Month,Origin,Dest\n2010,3,AAA,BBB\n")
    (tmp_path / "b.csv").write_text("\ufeffDest,Month,OriginState,Year,more\nDDD,7,TX,2011,x\nEEE,8,TX\nFFF,x,TX,2012,y\n")
    (tmp_path / "empty.csv").write_text("")
    got = {(r.Year, r.Month, r.Origin, r.Dest, r.OriginState) for r in ontime.read_folder(spark, str(tmp_path)).collect()}
    assert got == {(2010, 3, "AAA", "BBB", None), (2011, 7, None, "DDD", "TX"), (2012, None, None, "FFF", "TX")}
    assert "ORIGIN_STATE_ABR" not in ontime.read_folder(spark, str(tmp_path)).columns
    (bad,) = ontime.read_csv(spark, str(tmp_path / "*.csv"), with_errors=True).filter("error is not null").collect()
    assert bad.path.endswith("b.csv") and bad.error == "EEE,8,TX"
    (tmp_path / "none").mkdir()
    assert ontime.read_folder(spark, str(tmp_path / "none")).collect() == []


def test_archive_rows_that_do_not_fit(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.csv", b"Month,Year,Origin\n1,2010,A\xff\n2,2010\n3,2010,\n")
    assert [(r.Year, r.Month, r.Origin) for r in ontime.read_folder(spark, str(tmp_path)).collect()] == [(2010, 1, "A\ufffd"), (2010, 3, None)]
    (bad,) = ontime.read_archives(spark, str(tmp_path / "*.zip"), with_errors=True).filter("error is not null").collect()
    assert "2 columns for 3" in bad.error


def test_take_is_exact(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as k")
    one, two = ({r.id for r in sampling.take(df.repartition(n), 700).collect()} for n in (2, 5))
    assert one == two and len(one) == 700
    assert sampling.take(df, 9999).count() == 5000 and sampling.take(df, 0).count() == 0


def test_entry_point_without_corpus_operators(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("wayfare.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    names = set(e.queries())
    assert "a1_route" in names and not any(n.startswith("op") for n in names)
    assert set(e.oracle_sql()) <= names


def test_missing_columns():
    assert schema.missing(["Year", "x"], ["Year", "Month"]) == ["Month"] and schema.missing(schema.FEATURES) == []


def test_models_beat_chance_and_survive_saving(spark, tmp_path):
    from wayfare.ml import models

    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(3000).select("id", *(F.lit(0.5).alias(c) for c in schema.NUMERIC if c != "DepHour"), (F.col("id") % 24).alias("DepHour"), *(F.concat(F.lit("v"), F.col("id") % 3).alias(c) for c in schema.CATEGORICAL))
    rows = rows.withColumn("label", (h < F.col("DepHour") / 24.0).cast("double")).drop("id")
    train, test = rows.filter("DepHour % 2 = 0"), rows.filter("DepHour % 2 = 1").withColumn("Route", F.lit("never seen"))
    for fit in (models.fit_logistic, lambda t: models.fit_trees(t, 3, 5)):
        model = fit(train)
        scored = models.score(model, test)
        assert scored.count() == test.count() and metrics.quality(scored, ["p"], "p").filter("bad > 0").count() == 0
        assert metrics.ranking(scored).first().roc_auc > 0.75
    models.save(model, str(tmp_path / "m"))
    again = models.score(models.load(str(tmp_path / "m")), test)
    assert abs(again.agg(F.avg("p")).first()[0] - scored.agg(F.avg("p")).first()[0]) < 1e-9
    calibrated = models.Calibrator(models.score(model, train))(scored).orderBy("p").select("p").collect()
    assert all(0 <= r.p <= 1 for r in calibrated)
    assert models.importance(model).count() == 25


def test_safer_hours_of_all_requests(spark, monkeypatch):
    from wayfare.plans import ml_queries, more_queries
    from wayfare.plans import views as v
    from wayfare.plans.registry import QUERIES

    names = "Reporting_Airline string, Origin string, Dest string, DepHour int, FlightDate date, Distance double, Year int"
    rows = [("A", f"NATION_{i % 3}", "X", i % 24, dt.date(1998 + i % 4, 1, 1), 10.0, 1998 + i % 4) for i in range(30)]
    price = lambda h: float(h * 7 % 24)
    every = lambda hours: F.explode(F.array(*map(F.lit, hours)))
    build = lambda rows, meta, keep, hours: rows.withColumn("DepHour", every(hours)).withColumn("p", F.pmod(F.col("DepHour") * 7, F.lit(24)).cast("double"))
    monkeypatch.setattr(recommend, "build_features", build)
    monkeypatch.setattr(v, "cleaned", lambda s, d: s.createDataFrame(rows, names))
    for module in (more_queries, ml_queries):
        monkeypatch.setattr(module, "meta_of", lambda s, d: None)
    monkeypatch.setattr(more_queries, "expression_score", lambda x: x)
    monkeypatch.setattr(ml_queries, "splits", lambda s, d: (None, None, None))
    monkeypatch.setattr(ml_queries.models, "fit_logistic", lambda t: None)
    monkeypatch.setattr(ml_queries.models, "task", lambda x, label: x)
    monkeypatch.setattr(ml_queries.models, "score", lambda m, x: x)
    want = {("|".join(map(str, r[:4])), k + 1, h) for r in rows for k, h in enumerate(sorted((h for h in range(24) if h != r[3]), key=price)[:3])}
    for name in ("r2_safer_hours_all", "r2_safer_hours_model"):
        assert {(r.request_id, r.place, r.DepHour) for r in QUERIES[name](spark, "").collect()} == want


def test_bootstrap_queries_take_scores_as_they_are(spark, monkeypatch):
    from wayfare.plans import all_queries
    from wayfare.plans import views as v

    queries = all_queries()[0]
    rows = [(i % 2, 0.5 + i * 1e-4 * (1 if i % 2 else -1), 0.5) for i in range(40)]  # p_a ranks perfectly, but not at two digits
    monkeypatch.setattr(v, "scored", lambda s, d: s.createDataFrame(rows, "label int, p_a double, p_b double"))
    for name in ("e18_bootstrap", "e18_bootstrap_auc"):
        r = queries[name](spark, "").first()
        assert r.replicates == 400
    assert abs(r.mean_difference + 0.5) < 1e-9 and abs(r.low + 0.5) < 1e-9 and abs(r.high + 0.5) < 1e-9


def test_backtest_of_both_tasks(spark, monkeypatch):
    from wayfare.plans import ml_queries as q

    rows = [(i % 2, int(i % 10 == 0), i / 100) for i in range(100)]
    monkeypatch.setattr(q, "splits", lambda *a: (None, None, None))
    monkeypatch.setattr(q, "meta_of", lambda *a: None)
    monkeypatch.setattr(q.v, "cleaned", lambda *a: None)
    monkeypatch.setattr(q.clean, "year_guard", lambda *a: None)
    monkeypatch.setattr(q, "itineraries", lambda *a: None)
    monkeypatch.setattr(q, "build_features", lambda *a: spark.createDataFrame(rows, "ArrDel15 int, Cancelled int, p double"))
    monkeypatch.setattr(q.models, "fit_logistic", lambda t: None)
    monkeypatch.setattr(q.models, "task", lambda x, label: x.withColumn("label", F.col(label)))
    monkeypatch.setattr(q.models, "score", lambda m, x: x)
    got = q.backtest(spark, "").collect()
    assert sorted((r.task, r.part) for r in got) == sorted((t, p) for t in ("ArrDel15", "Cancelled") for p in ["core"] + ["stratification"] * 5)
    core = {r.task: r for r in got if r.part == "core"}
    assert core["ArrDel15"].base_rate == 0.5 and core["Cancelled"].base_rate == 0.1 and core["Cancelled"].roc_auc is not None


def test_logistic_query_uses_its_grid(spark, monkeypatch):
    from wayfare.ml import models
    from wayfare.plans import ml_queries as q

    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(300).select((F.col("id") % 24).cast("double").alias("DepHour"), (h < (F.col("id") % 24) / 24.0).cast("double").alias("label"))
    real, grids = models.fit_logistic, []

    def small(train, grid=()):
        grids.append(grid)
        return real(train, ["DepHour"], [], grid[:2])

    monkeypatch.setattr(q, "splits", lambda *a: (rows, None, rows))
    monkeypatch.setattr(models, "fit_logistic", small)
    assert q.logistic(spark, "").first().roc_auc > 0.75 and grids == [(0.1, 0.3, 1.0, 3.0)]


def test_quantiles_by_ranks(spark):
    df = spark.range(997).select((F.pmod(F.xxhash64("id"), F.lit(300)) / 250.0).alias("p")).unionByName(spark.createDataFrame([(None,)], "p double"))
    qs = [0.05, 0.1, 0.333, 0.5, 0.9, 0.95]
    found = metrics.quantile(df, qs)
    assert "percentile(" not in found._jdf.queryExecution().toString()
    want = df.agg(F.percentile("p", F.array(*map(F.lit, qs))).alias("c")).first().c
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(found.first().cut, want))
    assert metrics.quantile(df.limit(0), 0.9).first().cut is None


def test_score_ranges_are_even_however_close_scores_lie(spark):
    df = spark.range(20_000).select((F.lit(0.001) + F.col("id") * 1e-9).alias("p"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    sizes = metrics.ranged(df).groupBy("_r").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("_r").collect()
    assert len(sizes) > 0.9 * metrics.RANGES and max(r.n for r in sizes) < 60
    assert all(x.hi < y.lo for x, y in zip(sizes, sizes[1:])) and sum(r.n for r in sizes) == 20_000
    assert abs(metrics.ranking(df).first().roc_auc - 0.5) < 0.01
    outside = spark.createDataFrame([(-5.0, 0), (7.0, 1), (7.5, 0), (9.0, 1)], "p double, label int")
    assert metrics.ranking(outside).first().roc_auc == 0.75


def test_metric_rows_and_their_report(spark):
    from wayfare.sources import reports

    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, p double")
    one = metrics.metric_row(scored, "trees", "test", 0.5, top=0.9)
    none = metrics.metric_row(scored.filter("p > 2"), "trees", "val", 0.5)
    assert one.columns == ["context", "split", "threshold", "roc_auc", "pr_auc", "brier", "top_bucket_rate", "top_bucket_quantile", "accuracy", "precision_pos", "recall_pos", "f1_pos"]
    r = one.first()
    assert (r.roc_auc, r.top_bucket_rate, r.top_bucket_quantile, r.accuracy, r.recall_pos) == (0.75, 1.0, 0.9, 0.75, 1.0)
    lines = [x.value for x in reports.metric_lines(one.unionByName(none)).collect()]
    assert lines[:3] == ["trees / test", "Threshold: 0.500", "ROC-AUC: 0.7500"]
    assert lines[9:12] == ["Top 10% bucket positive rate: 1.0000", "trees / val", "Threshold: 0.500"]
    assert lines[12] == "ROC-AUC: N/A" and not any(x.startswith("Top") for x in lines[12:])


def test_backtest_summary_lines(spark):
    from wayfare.sources import reports

    core = metrics.core(spark.createDataFrame([(0, 0.9), (0, 0.2)], "label int, p double")).select(F.lit("Cancelled").alias("task"), "*")
    lines = [x.value for x in reports.backtest_lines(core).collect()]
    assert lines == ["Task: Cancelled", "Samples: 2", "Base rate: 0.0000", "ROC-AUC: N/A", "PR-AUC: N/A", "Brier: 0.4250", "Top bucket positive rate: 0.0000", "Share of all events in top bucket: N/A"]


# -- training -----------------------------------------------------------------------------------------------------------
def learnable(spark, n, first=0, flip=False):
    """Rows of all features; the label follows the hour (or its opposite), whatever else."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(first, first + n).select("id", *(F.lit(0.5).alias(c) for c in schema.NUMERIC if c != "DepHour"), (F.col("id") % 24).cast("double").alias("DepHour"), *(F.concat(F.lit("v"), F.col("id") % 3).alias(c) for c in schema.CATEGORICAL))
    up = h < F.col("DepHour") / 24.0
    return rows.withColumn("label", (~up if flip else up).cast("double")).drop("id")


def test_every_fit_refuses_one_class(spark):
    from wayfare.ml import models

    rows = learnable(spark, 50).withColumn("label", F.lit(0.0))
    for fit in (models.fit_logistic, models.fit_trees, lambda t: models.fit_trees_on_grid(t, t), lambda t: models.fit_network(t, t)):
        with pytest.raises(models.OneClass):
            fit(rows)


def test_crossfit_means_hold_no_own_label(spark):
    from wayfare.ml import models

    rows = spark.range(600).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("double").alias("label"), (F.col("id") % 5).cast("int").alias("fold"))
    got = models.crossfit_means(rows, ["key", "g"], smoothing=10.0).collect()
    assert len(got) == 600
    for r in got[:60]:
        other = [x for x in got if x.fold != r.fold]
        prior = sum(x.label for x in other) / len(other)
        same = [x.label for x in other if x.g == r.g]
        assert math.isclose(r.key_enc, prior) and math.isclose(r.g_enc, (sum(same) + 10 * prior) / (len(same) + 10))
    whole = models.crossfit_means(rows, ["key", "g"], smoothing=10.0, plenty=100).collect()
    overall = sum(x.label for x in got) / len(got)
    for r in whole[:60]:  # large groups have one mean, small ones that of the other folds
        same = [x.label for x in got if x.g == r.g]
        assert math.isclose(r.g_enc, (sum(same) + 10 * overall) / (len(same) + 10))
        assert math.isclose(r.key_enc, next(x.key_enc for x in got if x.key == r.key))
    # an id has no signal: within a fold all rows have one value
    assert all(len({round(x.key_enc, 12) for x in got if x.fold == f}) == 1 for f in range(5))


def test_tree_grid_reports_every_setting(spark):
    from wayfare.ml import models

    train, val = learnable(spark, 1500), learnable(spark, 600, 5000)
    grid = (models.Trees(1, 1, 0.1, 700), models.Trees(3, 4), models.Trees(2, 3, 0.3))
    for stopping in (False, True):
        model, rows = models.fit_trees_on_grid(train, val, grid, stopping)
        rows = rows.collect()
        assert [(r.depth, r.rounds, r.step, r.least) for r in rows] == [(1, 1, 0.1, 700), (3, 4, 0.1, 20), (2, 3, 0.3, 20)]
        assert [r.chosen for r in rows].count(True) == 1 and next(r for r in rows if r.chosen).val_auc == max(r.val_auc for r in rows) > 0.7
        assert metrics.ranking(models.score(model, val)).first().roc_auc > 0.7


def test_settings_are_tried_on_all_training_rows(spark, monkeypatch):
    from wayfare.ml import models

    real, seen = models.search, []
    monkeypatch.setattr(models, "TUNING_ROWS", 200, raising=False)
    monkeypatch.setattr(models, "search", lambda e, parts, *a: seen.append([(x.count(), y.count()) for x, y in parts]) or real(e, parts, *a))
    train, val = learnable(spark, 900), learnable(spark, 300, 5000)
    for stopping in (False, True):
        models.fit_trees_on_grid(train, val, (models.Trees(1, 1), models.Trees(2, 2)), stopping)
    models.fit_logistic(train, ["DepHour"], [], (0.1, 1.0))
    assert seen[:2] == [[(900, 300)]] * 2 and sum(held for _, held in seen[2]) == 900 and all(a + b == 900 for a, b in seen[2])


def test_network_keeps_its_best_stage(spark, monkeypatch):
    from wayfare.ml import models

    train, val = learnable(spark, 1200), learnable(spark, 500, 5000)
    model, rows = models.fit_network(train, val, (4,), stages=3, epochs=8)
    assert [r.kept for r in rows.collect()].count(True) == 1 and metrics.ranking(models.score(model, val)).first().roc_auc > 0.7
    # what is worse later is dropped, and training ends after `patience` stages
    aucs, seen = iter([0.6, 0.9, 0.8, 0.7, 0.95]), []
    monkeypatch.setattr(models, "_auc", lambda m, _: (seen.append(m), next(aucs))[1])
    model, rows = models.fit_network(train, val, (4,), stages=5, epochs=2, patience=2)
    assert [(r.stage, r.kept) for r in rows.collect()] == [(0, False), (1, True), (2, False), (3, False)]
    assert model.stages[-1].weights == seen[1].weights != seen[3].weights


def test_network_is_fitted_on_weighted_rows(spark, monkeypatch):
    import numpy as np

    from wayfare.ml import models

    rng, layers = np.random.default_rng(1), [3, 4, 2]
    x, y, w = rng.normal(size=(50, 3)), rng.integers(0, 2, 50), rng.random(50) * 9
    at = rng.normal(size=(3 + 1) * 4 + (4 + 1) * 2)
    loss, grad = models.network_loss(at, layers, x, y, w)
    for i in range(len(at)):
        step = np.eye(len(at))[i] * 1e-5
        assert math.isclose((models.network_loss(at + step, layers, x, y, w)[0] - models.network_loss(at - step, layers, x, y, w)[0]) / 2e-5, grad[i], rel_tol=1e-4, abs_tol=1e-5)
    low = list(models.itertools.islice(models.descent(lambda v: (float(((v - 3) ** 2 * [1, 50]).sum()), 2 * (v - 3) * [1, 50]), np.zeros(2)), 30))[-1]
    assert np.allclose(low, 3, atol=1e-4)
    # MLlib's model computes what the loss was taken of
    net = models.MultilayerPerceptronClassifier(layers=layers, maxIter=0, initialWeights=models.Vectors.dense(at))
    rows = spark.createDataFrame([(float(b), models.Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    p = np.array([r.probability.toArray() for r in net.fit(rows).transform(rows).collect()])
    assert math.isclose(-(w * np.log(p[np.arange(50), y])).sum(), loss, rel_tol=1e-9)
    monkeypatch.setattr(models, "balanced", lambda *a: 1 / 0)  # no row is repeated by its weight
    train = learnable(spark, 600)
    assert models.fit_network(train, train, (4,), stages=1, epochs=12)[1].first().val_auc > 0.7


def test_balanced_rows_weigh_the_same(spark):
    from pyspark.ml.functions import array_to_vector

    from wayfare.ml import models

    rows = spark.range(4000).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 8 == 0).cast("double").alias("label"))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 2.6).otherwise(1.0))
    n = dict(models.balanced(rows).groupBy("label").count().collect())
    assert n[0.0] == 3500 and abs(n[1.0] - 1300) < 60


def test_bundle_is_whole_after_loading(spark, tmp_path):
    from wayfare.ml import models

    train, val = learnable(spark, 1500), learnable(spark, 800, 5000)
    made = models.Bundle.of(models.fit_logistic(train), val, "ArrDel15")
    made.save(str(tmp_path / "b"))
    again = models.Bundle.load(str(tmp_path / "b"))
    assert (again.task, again.columns, again.threshold) == (made.task, tuple(schema.FEATURES), made.threshold)
    a, b = (sorted((r.DepHour, r.p, r.alarm) for r in x(val).collect()) for x in (made, again))
    assert a == b and all(0 <= p <= 1 and alarm == (p >= made.threshold) for _, p, alarm in a)
    by_p = models.score(again.model, val).groupBy("p").agg(F.avg("label").alias("rate")).collect()
    assert all(abs(r.p - r.rate) < 0.2 for r in by_p)  # isotonic on these very rows
    with pytest.raises(ValueError, match="Dest_snow"):
        again(val.drop("Dest_snow"))


@pytest.mark.parametrize("metric", ["roc_auc", "brier"])
def test_bootstrap_by_plain_weights(spark, monkeypatch, metric):
    """Against a replicate at a time with the same weights; ties, repeated rows and many small parts included."""
    import numpy as np

    from wayfare.operators import bootstrap

    monkeypatch.setattr(bootstrap, "_ENTRIES", 7 * 30)
    rnd = np.random.default_rng(4)
    rows = [(int(y), float(np.round(x, 1)), float(np.round(z + 0.3 * y, 2))) for y, x, z in zip(rnd.integers(0, 2, 500), rnd.random(500), rnd.random(500))]
    rows += [(1, 0.5, 0.5)] * 40 + [(0, 0.5, 0.5)] * 3 + [(1, None, 0.5)]
    df = spark.createDataFrame(rows, "label int, p_a double, p_b double")
    got = bootstrap.bootstrap_difference(df, metric, 30, 9).first()
    keys = spark.createDataFrame(rows, df.schema).na.drop().groupBy("label", "p_a", "p_b").agg(F.count("*").alias("n"), F.xxhash64(F.lit(9), "label", "p_a", "p_b").alias("k")).collect()
    w = bootstrap.poisson_weights(np.array([r.k for r in keys]).view(np.uint64), np.array([r.n for r in keys]), 30)
    y, a, b = (np.array([r[i] for r in keys], float) for i in range(3))

    def auc(p, w):
        pos, neg = y == 1, y == 0
        more = (p[pos][:, None] > p[neg][None, :]) + (p[pos][:, None] == p[neg][None, :]) / 2
        return w[pos] @ more @ w[neg] / (w[pos].sum() * w[neg].sum())

    if metric == "brier":
        d = [(w[:, i] @ ((a - y) ** 2 - (b - y) ** 2)) / w[:, i].sum() for i in range(30)]
    else:
        d = [auc(b, w[:, i]) - auc(a, w[:, i]) for i in range(30)]
    assert math.isclose(got.mean_difference, np.mean(d), rel_tol=1e-9)
    assert math.isclose(got.low, np.percentile(d, 2.5), rel_tol=1e-9) and math.isclose(got.high, np.percentile(d, 97.5), rel_tol=1e-9)


def test_poisson_weights_have_their_moments():
    import numpy as np

    from wayfare.operators import bootstrap

    for n in (1, 7, 400):
        w = bootstrap.poisson_weights(np.arange(2000, dtype=np.uint64), np.full(2000, n), 50)
        assert abs(w.mean() - n) < 0.02 * n + 0.01 and abs(w.var() - n) < 0.03 * n and (w == w.round()).all()


# -- sources and sinks --------------------------------------------------------------------------------------------------
def test_archives_are_a_data_source_that_reads_wanted_columns(spark, tmp_path):
    rows = spark.range(5000).select((F.lit(2000) + F.col("id") % 2).cast("int").alias("Year"), (F.col("id") % 3 + 1).cast("int").alias("Month"), F.concat(F.lit("a,\"b"), F.col("id")).alias("Origin"), F.col("id").cast("double").alias("Distance"))
    ontime.write_archives(rows, str(tmp_path / "z"), ["Year", "Month"])
    ontime.write_archives(rows, str(tmp_path / "z"), ["Year", "Month"])  # replaces them
    assert len(list((tmp_path / "z").iterdir())) == 6
    got = ontime.read_archives(spark, f"file:{tmp_path}/z", columns=["Distance", "Origin", "ArrDel15"])
    assert got.columns == ["Origin", "Distance", "ArrDel15"] and "OnTimeArchives" in got._jdf.queryExecution().toString() or "ontime_archives" in got._jdf.queryExecution().toString()
    assert got.agg(F.count("*"), F.sum("Distance"), F.count("ArrDel15"), F.count_distinct("Origin")).first() == (5000, 4999 * 2500.0, 0, 5000)
    assert got.rdd.getNumPartitions() == 6
    ontime.cut_short(spark.createDataFrame([("2000-1",)], "name string"), str(tmp_path / "z"))
    both = ontime.read_archives(spark, str(tmp_path / "z" / "*.zip"), with_errors=True, columns=["Distance"])
    assert [(r.path.rsplit("/", 1)[1], "Bad" in r.error) for r in both.filter("error is not null").collect()] == [("2000-1.zip", True)]
    assert both.filter("error is null").count() == rows.filter("Year <> 2000 or Month <> 1").count()
    assert ontime.read_archives(spark, str(tmp_path / "none*.zip")).count() == 0


def test_one_year_is_written_again(spark, tmp_path):
    from wayfare.sources import reports

    at = str(tmp_path / "t")
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("Year"), "id")
    reports.write_partitioned(rows, "Year", at, file_rows=200)
    assert all(len(list((tmp_path / "t" / f"Year={y}").glob("*.parquet"))) >= 5 for y in range(3))  # by size, not by a fixed number
    again = reports.write_partitioned(rows.filter("Year = 1 and id < 10"), "Year", at)
    assert dict(again.groupBy("Year").count().collect()) == {0: 1000, 1: 3, 2: 1000}


def test_checks_are_taken_while_writing(spark):
    from wayfare.sources import reports

    rows = spark.createDataFrame([(0.5, "a"), (float("nan"), "b"), (None, "c"), (7.0, "d")], "p double, name string")
    table, checks = reports.write_observed(rows, ["p"], {"p": (0.0, 1.0)}, ["name", "p", "q"])
    assert table.count() == 4
    assert dict(checks.collect()) == {"rows": 4, "p": 2, "p outside 0..1": 2, "missing columns": 1, "columns out of place": 3}


def test_holidays_of_any_year(spark):
    """Against a list of days made by plain counting, for years far from today."""

    def nth(y, m, wd, n):
        days = [d for d in (dt.date(y, m, 1) + dt.timedelta(i) for i in range(31)) if d.month == m and d.weekday() == wd]
        return days[n - 1] if n > 0 else days[-1]

    fixed, moving = calendar.FIXED, calendar.FLOATING
    names = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    for first in (1949, 2021, 2088):
        kept, plain = set(), set()
        for y in range(first - 1, first + 4):
            for m, d, since in fixed:
                day = dt.date(y, m, d)
                if y >= since:
                    kept.add(day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0)))
                if not since:
                    plain.add(day)
            for m, wd, n in moving:
                kept.add(nth(y, m, names.index(wd), n))
                plain.add(nth(y, m, names.index(wd), n))
        days = [dt.date(first, 1, 1) + dt.timedelta(i) for i in range(1000)]
        df = spark.createDataFrame([(d,) for d in days] + [(None,)], "FlightDate date")
        one = dt.timedelta(1)
        for made, hits, same in ((calendar.add_observed_flags(df), kept, False), (calendar.add_plain_flags(df), plain, True)):
            for r in made.collect():
                d = r.FlightDate
                near = lambda x: int(x in hits and (not same or x.year == d.year))
                want = (near(d), near(d + one), near(d - one)) if d else (0, 0, 0)
                assert (r.IsHoliday, r.IsDayBeforeHoliday, r.IsDayAfterHoliday) == want


def lookups(spark):
    rows = []
    for i in range(600):
        r = {c: float((i * 7 + k) % 5) for k, c in enumerate(schema.WEATHER)}
        r |= {"Reporting_Airline": "AB"[i % 2], "Origin": "XYZ"[i % 3], "Dest": "XYZ"[(i // 3) % 3], "OriginState": [None, "s", "t"][i % 3], "DestState": "stu"[(i // 3) % 3]}
        r |= {"FlightDate": dt.date(1998, 1 + i % 4, 1 + i % 25), "DepHour": i % 24, "Distance": 100.0 * (i % 4), "Cancelled": int(i % 10 == 0), "ArrDel15": None if i % 10 == 0 else float(i % 3 == 0)}
        r |= {"RouteDelayRate": 0.1, "RouteCancelRate": 0.2, "RouteFlights": i % 3, "AirlineDelayRate": 0.3, "AirlineCancelRate": 0.1, "AirlineFlights": 5, "OriginSlotFlights": float(i % 6)}
        rows.append(r)
    df = spark.createDataFrame(rows, "Reporting_Airline string, Origin string, Dest string, OriginState string, DestState string, FlightDate date, DepHour int, Distance double, Cancelled int, ArrDel15 double, RouteDelayRate double, RouteCancelRate double, RouteFlights int, AirlineDelayRate double, AirlineCancelRate double, AirlineFlights int, OriginSlotFlights double, " + ", ".join(f"{c} double" for c in schema.WEATHER))
    return df.withColumns(flight.date_parts("FlightDate"))


def test_lattice_gives_the_tables_of_single_passes(spark):
    rows = lookups(spark)
    made = metadata.Lattice(rows)
    same = lambda a, b: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.select(*b.columns).collect()), key=str) == sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect()), key=str)
    assert same(made.means(stats.ROUTE, ["RouteDelayRate", "RouteCancelRate", "RouteFlights"]), metadata.route_meta(rows))
    assert same(made.means(stats.AIRLINE, ["AirlineDelayRate", "AirlineCancelRate", "AirlineFlights"]), metadata.airline_meta(rows))
    assert same(made.slot(), metadata.slot_meta(rows)) and same(made.daily(), metadata.daily_meta(rows)) and same(made.daily(True), metadata.daily_meta(rows, True))
    assert same(made.hubs("Origin", "h", 0.3, 20), stats.hubs(rows, "Origin", "h", 0.3, 20)) and same(made.pairs(), metadata.route_pair_meta(rows))
    assert same(made.climatology("Dest"), metadata.climatology(rows, "Dest")) and same(made.states(), metadata.airport_states(rows)) and same(made.defaults(), metadata.defaults(rows))


def test_rows_multiply_behind_the_lookups(spark):
    from wayfare.operators import features

    rows = lookups(spark)
    meta = features.Metadata(rows, 0.3, 20)
    requests = rows.limit(40).select(F.monotonically_increasing_id().alias("request_id"), "FlightDate", "DepHour", "Reporting_Airline", "Origin", "Dest", "Distance")
    late = features.build_features(requests, meta, ["request_id"], hours=list(range(24)))
    early = features.build_features(requests.withColumn("DepHour", F.explode(F.sequence(F.lit(0), F.lit(23)))), meta, ["request_id"])
    assert late.exceptAll(early).count() == 0 and early.exceptAll(late).count() == 0 and late.count() == 40 * 24
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    grown = plan.index("Generate explode(")
    assert plan[:grown].count("Join LeftOuter") == 0 and plan[grown:].count("Join LeftOuter") >= 9
    flown = meta.route.filter("RouteFlights > 0").select("Origin", "Dest", "Reporting_Airline")
    early = features.build_features(requests.drop("Reporting_Airline").join(flown, ["Origin", "Dest"]), meta, ["request_id"])
    late = features.build_features(requests, meta, ["request_id"], airlines=True)
    assert late.exceptAll(early).count() == 0 and early.exceptAll(late).count() == 0 and late.count() > 40


def test_queries_leave_only_their_result(spark):
    import os

    from wayfare.plans import all_queries
    from wayfare.sources import tables

    queries, at = all_queries()[0], tables.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    df = queries["p16_round_trip"](spark, "/root/testdata/sf0.001")
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and next(iter(left)).startswith("result-") and df.count() > 0
    with pytest.raises(ZeroDivisionError):
        tables.tidy(spark, lambda: (tables.written(df), 1 / 0)[0])
    assert set(os.listdir(at)) - before == left
    with tables.scope(spark):
        assert tables.tidy(spark, lambda: tables.written(spark.range(5)).filter("id > 2")).count() == 2
    assert set(os.listdir(at)) - before == left
    queries["f2_diverted"](spark, "/root/testdata/sf0.001").count()  # writes nothing
    assert set(os.listdir(at)) - before == left


def test_backtest_sample_and_serving_states(spark):
    from wayfare.ml import models

    rows = spark.range(900).withColumn("k", F.col("id") % 7)
    assert models.backtest_rows(rows, 100).count() == 100 and models.backtest_rows(rows) is rows
    assert models.backtest_rows(rows, 100).exceptAll(models.backtest_rows(rows.repartition(7), 100)).count() == 0
    df = spark.createDataFrame([("a", "b", "c")], "Origin_State string, OriginStateName string, DEST_STATE_NM string")
    assert clean.standard_states(df, schema.SERVING_STATE_CANDIDATES).select("OriginState", "DestState").first() == ("a", "c")
    assert clean.standard_states(df).select("OriginState", "DestState").first() == ("b", "c")


def test_best_threshold_at_the_thresholds_themselves(spark):
    rows = [(1, i / 100) for i in range(1, 100)] + [(0, i / 100 - 1e-12) for i in range(1, 100)] + [(0, 0.0), (1, 1.0), (0, -3.0), (1, 7.0), (0, None)]
    got = metrics.best_threshold(spark.createDataFrame(rows, "label int, p double")).first()
    f1 = lambda t: 2 * sum(y for y, p in rows if p is not None and p >= t) / (sum(p is not None and p >= t for _, p in rows) + sum(y for y, _ in rows))
    best = max((f1(i / 100), -i) for i in range(1, 100))
    assert got.threshold == -best[1] / 100 and math.isclose(got.f1, best[0])


def test_a_query_makes_prepared_trips_once_and_nothing_is_shuffled_by_airline(spark, monkeypatch):
    from wayfare.plans import views as v
    from wayfare.sources import tables

    made, real, sf = [], v.trips, "/root/testdata/sf0.001"
    monkeypatch.setattr(v, "trips", lambda s, d: made.append(d) or real(s, d))
    with tables.scope(spark):
        a, b = v.prepared(spark, sf), v.prepared(spark, sf)
        assert v.requests(v.cleaned(spark, sf)).count() > 0 and a.count() == b.count() and made == [sf]
        plan = v.attached(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 7 and "hashpartitioning" not in plan
    with tables.scope(spark):
        assert v.cleaned(spark, sf).columns and len(made) == 2  # another query starts anew


def test_code_of_cleaning_is_small_enough_to_be_compiled(spark):
    days = spark.createDataFrame([(dt.date(2021, 6, 18), "x")], "FlightDate date, b string")
    from wayfare.functions import calendar

    text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(calendar.add_observed_flags(days)._jdf.queryExecution().executedPlan())
    assert max(int(x.split(";")[0]) for x in text.split("maxMethodCodeSize:")[1:]) < 6000


def test_samples_sort_one_range_only_and_are_those_of_ranks(spark):
    from wayfare.operators import sampling

    rows = spark.range(20_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    from pyspark.sql.window import Window

    ranked = rows.withColumn("h", sampling.row_hash(rows, 42)).withColumn("b", F.pmod(F.shiftrightunsigned("h", 40), F.lit(1024)))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("b", "h", "id")))
    want = {r.id for r in ranked.filter("r <= if(label = 1, 100, 900)").collect()}
    got = sampling.stratified(rows, "label", 1000)
    assert {r.id for r in got.collect()} == want and got.count() == 1000
    got = sampling.negatives(rows, "label", 0.1)
    assert {r.id for r in got.collect()} == {r.id for r in ranked.filter("label = 1 or r <= 1800").collect()}


def test_serving_tables_come_from_cells_without_preparing_trips(spark, monkeypatch):
    from wayfare.operators import features
    from wayfare.plans import base_queries
    from wayfare.plans import views as v
    from wayfare.sources import tables

    sf = "/root/testdata/sf0.001"
    rounded = lambda df, names: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str)
    with tables.scope(spark):
        want = features.Metadata(v.prepared(spark, sf), v.HUB_SHARE, v.HUB_LEAST)
        for name in ("prepared", "attached"):
            monkeypatch.setattr(v, name, lambda *a: 1 / 0)
        got = base_queries.meta_of(spark, sf)
        for name, table in vars(want).items():
            assert rounded(getattr(got, name), table.columns) == rounded(table, table.columns), name
    with tables.scope(spark):  # no trips of the years of the statistics
        rows = v.flown(spark, sf).filter("Year = 2000")
        made = metadata.DayLattice(rows, *v.TRAIN, tables.small(v.wx(spark, sf)))
        assert {r.RouteFlights for r in made.means(stats.ROUTE, ["RouteFlights"]).collect()} == {0.0}
        assert made.defaults().count() == 1 and made.slot().filter("OriginSlotFlights is not null").count() == 0


def test_requests_are_found_without_sorting_trips(spark):
    from wayfare.plans import views as v
    from wayfare.sources import tables

    day = lambda d: dt.date(2000, 1, d)
    rows = [("A", "X", "Y", 1, day(1), 9.0), ("A", "X", "Y", 1, day(2), 3.0), ("A", "X", "Y", 1, day(2), 5.0), ("A", "X", "Y", 2, day(3), None), (None, "X", "Y", 2, day(3), 1.0)]
    df = spark.createDataFrame(rows, "Reporting_Airline string, Origin string, Dest string, DepHour int, FlightDate date, Distance double")
    with tables.scope(spark):
        got = v.requests(tables.written(df))
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in got.collect()} == {("A|X|Y|1", *rows[2]), ("A|X|Y|2", *rows[3]), ("X|Y|2", *rows[4])}


def test_queries_run_large_stages_in_small_methods_and_write_no_second_table_of_trips(spark):
    from wayfare.plans import ml_queries
    from wayfare.plans import views as v
    from wayfare.sources import tables

    name, seen, sf = "spark.sql.codegen.hugeMethodLimit", [], "/root/testdata/sf0.001"
    before = spark.conf.get(name)
    tables.tidy(spark, lambda: seen.append(spark.conf.get(name)) or spark.range(1))
    with pytest.raises(ZeroDivisionError):
        tables.tidy(spark, lambda: 1 / 0)
    assert seen == ["8000"] and spark.conf.get(name) == before
    with tables.scope(spark) as made:
        rows = v.prepared(spark, sf)
        n = len(made)
        parts = ml_queries.splits(spark, sf)
        assert len(made) == n and sum(x.count() for x in parts) == rows.filter("Cancelled = 0 and ArrDel15 is not null and Year between 1995 and 2001").count()


def test_models_read_equal_trips_once_and_weigh_them(spark):
    from wayfare.ml import models
    from wayfare.plans import views as v
    from wayfare.sources import tables

    sf, names = "/root/testdata/sf0.001", [*schema.FEATURES, "Cancelled", "ArrDel15"]
    with tables.scope(spark):
        cells = v.cells(spark, sf)
        sums = lambda df, n: {tuple(round(x, 9) if isinstance(x, float) else x for x in r[:-1]): r[-1] for r in df.groupBy(*names).agg(n.alias("n")).select(*names, "n").collect()}
        got = sums(cells, F.sum(schema.COUNT))
    with tables.scope(spark):
        want = v.prepared(spark, sf)
        assert got == sums(want, F.count("*")) and v.cells(spark, sf) is want  # what a query has made is read
    once = learnable(spark, 600).withColumn(schema.COUNT, F.pmod(F.xxhash64("DepHour", "label", "Route"), F.lit(4)) + 1)
    each = models.spread(once)
    assert each.count() == once.agg(F.sum(schema.COUNT)).first()[0] > 600 and schema.COUNT not in each.columns
    scored = [models.score(models.fit_logistic(x), x) for x in (once, each)]
    a, b = ({(r.DepHour, r.Route): r.p for r in x.collect()} for x in scored)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-3) for k in a)
    first = scored[0].localCheckpoint()
    for f in (metrics.core, metrics.stratification, metrics.best_threshold, metrics.brier, lambda x: metrics.ensemble_weight(x.withColumns({"p_a": F.col("p"), "p_b": F.lit(0.4)}))):
        x, y = (sorted(tuple(round(v, 9) for v in r) for r in f(t).collect()) for t in (first, models.spread(first)))
        assert x == y
    assert models.class_weights(once) == models.class_weights(each)
    vectors = [models.TreeVectors(x).of(x).groupBy("label").agg(F.sum("weight")).collect() for x in (once, each)]
    assert {r[0]: round(r[1], 6) for r in vectors[0]} == {r[0]: round(r[1], 6) for r in vectors[1]}
    encoded = [{r.Route: r.Route_enc for r in models.PipelineModel(models.TreeVectors(x).serving.stages[:2]).transform(x).select("Route", "Route_enc").distinct().collect()} for x in (once, each)]
    assert len(encoded[0]) == 3 and all(math.isclose(encoded[0][k], encoded[1][k]) for k in encoded[0])
    by_hour = [{r.DepHour: r.c for r in models.calibrated(models.fit_logistic(each), x).transform(each).groupBy("DepHour").agg(F.avg("calibrated").alias("c")).collect()} for x in (once, each)]
    assert all(math.isclose(by_hour[0][h], by_hour[1][h], abs_tol=1e-6) for h in by_hour[0])

from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_layers import RAW_NAMES, frame, raw_row
from wellpanel.operators import champion as CH
from wellpanel.operators import model as MD
from wellpanel.operators import quality as Q
from wellpanel.operators import supervised as SV
from wellpanel.streaming import arrivals as AR
from wellpanel.streaming import service_metrics as SM

LINEAR = MD.ModelSpec(kind="linear")
TREES = MD.ModelSpec(trees=3, depth=2, min_rows=1)


@pytest.fixture(scope="module")
def rows(features, series):
    return SV.training_dataset(features, series, (1, 2, 3)).cache()


def test_model_ignores_naive_and_target_and_is_repeatable(rows):
    a = MD.predict(MD.fit(rows, TREES), rows).select("well_id", "as_of_date", "horizon", "prediction_m3")
    b = MD.predict(MD.fit(rows, TREES), rows.withColumn("naive_forecast_m3", F.lit(1e9))).select(*a.columns)
    assert a.collect() == b.collect() and a.filter("prediction_m3 is null").count() == 0
    with pytest.raises(ValueError, match="missing model columns"):
        MD.model_input(rows.drop("basin"))


def test_batch_forecast_maps_months(spark, rows, features):
    asked = spark.createDataFrame([("shutin", dt.date(2023, 3, 15)), ("young", dt.date(2020, 1, 1))], "well_id string, as_of_date date")
    fitted = MD.fit(rows, LINEAR)
    out = MD.forecast(fitted, features.drop("feature_key"), asked, 5).collect()
    ok = sorted((r.horizon, str(r.month), r.extrapolated) for r in out if r.status == "ok")
    assert ok == [(1, "2023-04-01", False), (2, "2023-05-01", False), (3, "2023-06-01", False), (4, "2023-07-01", True), (5, "2023-08-01", True)]
    assert [(r.well_id, r.status) for r in out if r.status != "ok"] == [("young", "missing")]
    with pytest.raises(ValueError):
        MD.forecast(fitted, features, asked, 13)
    bad = spark.createDataFrame([("shutin", dt.date(1850, 1, 1))], asked.schema)
    with pytest.raises(PySparkException, match="out of range"):
        MD.forecast(fitted, features.drop("feature_key"), bad, 1).collect()


VERSIONS = "model string, version string, run_id string, as_of_date date, metrics map<string,double>, gates_passed boolean, registered_at int"


def _versions(spark):
    day = dt.date(2026, 1, 1)
    return spark.createDataFrame(
        [
            ("oil", "1", "r1", day, {"m": 1.0}, True, 1), ("oil", "2", "r2", day, {"m": 1.0}, False, 2), ("oil", "3", "r3", day, {"m": 1.0}, True, 3),
            ("oil", "4", "r3", day, {"m": 1.0}, True, 4), ("oil", "5", "r5", None, {"m": 1.0}, True, 5), ("oil", "6", "r6", day, {}, True, 6), ("oil", "7", "r7", day, {"m": 1.0}, None, 7),
        ],
        VERSIONS,
    )


def _promote(spark, *events, model="oil"):
    return spark.createDataFrame([(i, model, v) for i, v in enumerate(events)], "requested_at int, model string, version string")


def test_champion_moves_only_to_approved_versions(spark):
    v = _versions(spark)
    assert {r.version: r.decision for r in CH.with_decision(CH.registered_versions(v)).collect()} == {
        "1": "promotable", "2": "rejected", "3": "promotable", "5": "incomplete", "6": "incomplete", "7": "incomplete",
    }
    assert CH.current_champion(v, _promote(spark, "1", "2")).first().version == "1"
    assert CH.current_champion(v, _promote(spark, "1", "3", "2", "6")).first().version == "3"
    back = CH.current_champion(v, _promote(spark, "1", "3", "1")).first()
    assert back.version == "1" and back.rollback
    assert CH.current_champion(v, _promote(spark, "2")).count() == 0
    CH.require_promotable(v, "oil", "1")
    with pytest.raises(CH.NotApproved):
        CH.require_promotable(v, "oil", "2")
    for incomplete in ("5", "6", "7", "99"):
        with pytest.raises(CH.MissingMetadata):
            CH.require_promotable(v, "oil", incomplete)


def test_versions_of_two_models_do_not_mix(spark):
    v = _versions(spark)
    both = v.unionByName(v.withColumn("model", F.lit("gas")).withColumn("registered_at", F.col("registered_at") + 10))
    assert CH.registered_versions(both).count() == 2 * CH.registered_versions(v).count()
    champions = CH.current_champion(both, _promote(spark, "1").unionByName(_promote(spark, "3", model="gas")))
    assert {(r.model, r.version) for r in champions.collect()} == {("oil", "1"), ("gas", "3")}
    with pytest.raises(CH.MissingMetadata):
        CH.require_promotable(v, "gas", "1")


def _checks():
    return Q.typed_production_checks("2014-06-01")


def test_arrivals_keep_newest_load_and_survive_retries(spark, tmp_path):
    inbox, lake, progress = (str(tmp_path / n) for n in ("inbox", "lake", "progress"))
    schema = ", ".join(f"{n} string" for n in RAW_NAMES)

    def arrive(rows):
        frame(spark, rows).write.mode("append").parquet(inbox)
        AR.run_arrivals(spark.readStream.schema(schema).parquet(inbox), lake, progress, _checks)
        return {(r.well_id, r.production_month.month): float(r.oil_prod_m3) for r in spark.read.parquet(lake).collect()}

    water = {"prod_agua": "1"}
    first = [raw_row(oil="1", load="1", **water), raw_row(well="2", oil="2", load="1", **water)]
    assert arrive(first) == {("77", 1): 1.0, ("2", 1): 2.0}
    assert arrive([raw_row(oil="5", load="3", **water), raw_row(mon="2", oil="7", load="3", **water)]) == {("77", 1): 5.0, ("77", 2): 7.0, ("2", 1): 2.0}
    late = frame(spark, [raw_row(oil="4", load="2", **water)])
    for _ in range(2):  # an older load, delivered twice
        AR.apply_batch(spark, late, lake, _checks())
    assert {float(r.oil_prod_m3) for r in spark.read.parquet(lake).filter("well_id = '77'").collect()} == {5.0, 7.0}
    with pytest.raises(Q.QualityError):
        AR.apply_batch(spark, frame(spark, [raw_row(year="1990", **water)]), lake, _checks())
    assert spark.read.parquet(lake).count() == 3


def _log(spark):
    start = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(i, start + dt.timedelta(seconds=20 * i), "/a" if i % 3 else "/b", "5xx" if i % 4 == 0 else "2xx", float(i), i % 4 == 0) for i in range(30)]
    return spark.createDataFrame(rows, "request_id long, ts timestamp, handler string, status string, latency double, is_error boolean")


def test_window_metrics(spark):
    log = _log(spark)
    rate = SM.request_rate(log).collect()
    assert len(rate) == 20 and sum(r.requests for r in rate) == 30 and {r.rate_per_second for r in rate} == {1 / 60, 2 / 60}
    assert sum(r.errors for r in SM.error_share(log).collect()) == 8
    assert sum(r.requests for r in SM.trailing_requests(log, False).collect()) == 30 * 6
    assert sum(r.requests for r in SM.mean_latency(log).collect()) == 30 * 5
    exact = {r.handler: r.p50 for r in SM.latency_percentiles(log, 3600).collect()}
    assert exact == {
        "/a": statistics.median(i for i in range(30) if i % 3),
        "/b": statistics.median(i for i in range(30) if i % 3 == 0),
    }


def test_bucket_quantiles(spark):
    counts = spark.createDataFrame([(10, 4, 8, 9)], "requests long, le_0 long, le_1 long, le_2 long")
    r = counts.select(*[SM.bucket_quantile(q, (1.0, 2.0, 4.0)).alias(f"q{int(q * 100)}") for q in (0.2, 0.5, 0.85, 0.99)]).first()
    assert (r.q20, r.q50, r.q85, r.q99) == (0.5, 1.25, 3.0, 4.0)


def test_alert_needs_consecutive_breaches(spark):
    start = dt.datetime(2024, 1, 1)
    values = [90, 90, 90, 90, 90, 90, 10, 90, 90, 90, 90]
    points = spark.createDataFrame([(start + dt.timedelta(minutes=i), "/a", float(v)) for i, v in enumerate(values)], "window_start timestamp, handler string, cpu double")
    fired = SM.sustained_alert(points, "cpu", ["handler"]).collect()
    assert sorted(r.firing_at for r in fired) == [start + dt.timedelta(minutes=m) for m in (4, 5)]


def test_stream_equals_batch_over_several_deliveries(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("log", "out", "progress"))
    log = _log(spark)
    for part in ("request_id < 13", "request_id >= 13"):
        log.filter(part).coalesce(1).write.mode("append").parquet(src)
        live = SM.request_rate(SM.watermarked(spark.readStream.schema(log.schema).parquet(src), "2 minutes"))
        SM.run_to_table(live, ["handler"], out, progress)
    want = SM.request_rate(log)
    assert sorted(map(tuple, spark.read.parquet(out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def _points(spark, values, handler="/a", at=dt.datetime(2024, 1, 1, 22, 0)):
    """Windows of an hour, some of them past midnight; values keyed by hour."""
    rows = [(at + dt.timedelta(hours=h), handler, float(v)) for h, v in values.items()]
    return spark.createDataFrame(rows, "window_start timestamp, handler string, latency double")


ALERT = {"threshold": 50.0, "held": 3, "step_seconds": 3600}


def test_alert_decides_only_what_a_batch_can_change(spark, tmp_path):
    """After every micro-batch the alerts equal the batch alert over all that has arrived; changes become events."""
    path, known = str(tmp_path / "a"), {}
    batches = [{0: 90, 1: 90}, {2: 90, 3: 90}, {5: 90, 6: 90}, {4: 90}, {1: 10}, {1: 90, 30: 90}, {40: 10}]
    firing = set()
    for k, batch in enumerate(batches):
        known |= batch
        for _ in range(2 if k in (3, 4) else 1):  # a batch that runs twice
            decided = SM.decide_alerts(_points(spark, batch), k, path, "latency", ["handler"], **ALERT)
            assert decided.count() == len({h + i for h in batch for i in range(3)})
        want = {tuple(r) for r in SM.sustained_alert(_points(spark, known), "latency", ["handler"], **ALERT).collect()}
        assert {tuple(r) for r in SM.current_alerts(spark, path, ["handler"]).collect()} == want
        events = {(r["handler"], r.firing_at, r.event) for r in spark.read.schema("firing_at timestamp, handler string, event string").parquet(f"{path}/events/batch_id={k:09d}").collect()}
        assert events == {(*w, "firing") for w in want - firing} | {(*w, "resolved") for w in firing - want}
        firing = want


def test_alert_stream_equals_the_batch_alert_after_each_delivery(spark, tmp_path):
    inbox, path, progress = (str(tmp_path / n) for n in ("in", "alerts", "progress"))
    start = dt.datetime(2024, 1, 1, 20)
    rows = [(start + dt.timedelta(minutes=10 * i), "/a" if i % 2 else "/b", 90.0 if i % 40 < 26 else 5.0) for i in range(160)]
    log = spark.createDataFrame(rows, "ts timestamp, handler string, latency double")
    assert SM.current_alerts(spark, path, ["handler"]).count() == 0
    for part in (rows[:50], rows[50:95], rows[95:]):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").parquet(inbox)
        live = SM.handler_latency(SM.watermarked(spark.readStream.schema(log.schema).parquet(inbox)), 3600)
        SM.run_alert(live, "mean_latency", ["handler"], path, progress, **ALERT)
        arrived = log.filter(F.col("ts") <= F.lit(part[-1][0]))
        want = SM.sustained_alert(SM.handler_latency(arrived, 3600), "mean_latency", ["handler"], **ALERT)
        assert {tuple(r) for r in SM.current_alerts(spark, path, ["handler"]).collect()} == {tuple(r) for r in want.select("handler", "firing_at").collect()}


def test_a_delivery_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    """r01: the table is rewritten once a delivery, however many files the delivery was written in."""
    from pyspark.sql import functions as F

    from wellpanel.plans import catalog

    applied, apply = [], AR.apply_batch
    monkeypatch.setattr(AR, "apply_batch", lambda *args: (applied.append(1), apply(*args)))
    real = catalog.BD.table
    monkeypatch.setattr(catalog.BD, "table", lambda spark, d, name: real(spark, d, name).repartition(5) if name == "lineitem" else real(spark, d, name))
    rows = catalog.QUERIES["r01_arrivals"](spark, "/root/testdata/sf0.001")
    assert len(applied) == 3
    assert rows.select(F.count_distinct("well_id", "production_month") == F.count(F.lit(1))).first()[0]

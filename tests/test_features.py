from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import EARLIER, LATER, own_wells
from tests.plain import by_well, features_of
from wellpanel.operators import features as FT
from wellpanel.operators.cutoffs import default_cutoff
from wellpanel.schema import FEATURE_CONTRACT

WELLS = by_well(own_wells())


def _check(df, cutoffs):
    found = {(r["well_id"], str(r["as_of_date"])): r for r in df.collect()}
    assert set(found) == {(w, c) for w in WELLS for c in cutoffs}
    for (well, cutoff), row in found.items():
        for name, want in features_of(WELLS[well], dt.date.fromisoformat(cutoff)).items():
            assert row[name] == (pytest.approx(want, rel=1e-9, abs=1e-9) if isinstance(want, (int, float)) else want), (well, cutoff, name)


def test_many_cutoffs_match_plain_python(features):
    _check(features, [EARLIER, LATER])
    assert set(FEATURE_CONTRACT) <= set(features.columns)


def test_single_cutoff_plan_gives_the_same(series, statics):
    _check(FT.well_features(series, statics, "2023-04-15"), [LATER])


def test_statistics_do_not_depend_on_the_order_of_rows(spark, series):
    first = FT.history_features(series.repartition(7), [EARLIER, LATER]).collect()
    second = FT.history_features(series.orderBy(F.rand(3)).repartition(3, "production_month"), [EARLIER, LATER]).collect()
    assert sorted(map(str, first)) == sorted(map(str, second))


def test_both_plans_agree_on_every_cutoff(series):
    every = [f"{y}-{m:02d}-01" for y in (2021, 2022) for m in range(1, 13)]
    many = FT.history_features(series, every)
    for cutoff in ("2021-02-01", "2021-11-01", "2022-06-01"):
        one = FT.history_features(series, cutoff)
        assert FT.audit_features(many.filter(F.col("as_of_date") == cutoff), series).count() == 0
        assert one.count() == many.filter(F.col("as_of_date") == cutoff).count()
    # cutoffs as a table, with a stale well seen long after its last month
    late = series.sparkSession.createDataFrame([(dt.date(2030, 5, 1),), (dt.date(2023, 4, 1),)], "as_of_date date")
    rows = {(r.well_id, str(r.as_of_date)): r for r in FT.history_features(series, late).collect()}
    assert len(rows) == 8
    assert rows["shutin", "2030-05-01"].months_with_history == len(WELLS["shutin"])
    assert rows["shutin", "2030-05-01"].months_since_last_observed == 83
    assert rows["shutin", "2030-05-01"].oil_prod_m3_roll_mean_12m is None


def test_default_cutoff_is_month_after_newest(series, statics):
    assert default_cutoff(series).first()[0] == dt.date(2023, 7, 1)
    cutoffs = {r.as_of_date for r in FT.well_features(series, statics).select("as_of_date").distinct().collect()}
    assert cutoffs == {dt.date(2023, 7, 1)}


def test_null_month_counts_as_history_but_not_as_value(spark, statics):
    rows = [("w", dt.date(2024, 1, 1), 5.0), ("w", dt.date(2024, 2, 1), None)]
    s = spark.createDataFrame(rows, "well_id string, production_month date, oil_prod_m3 double")
    r = FT.history_features(s, ["2024-03-01", "2024-04-01"]).filter("as_of_date = '2024-03-01'").first()
    assert r.months_with_history == 2 and r.last_observed_month == dt.date(2024, 2, 1)
    assert r.oil_prod_m3_lag_1m is None and r.oil_prod_m3_roll_mean_3m == 5.0 and r.oil_prod_m3_roll_std_6m is None


def test_audit_finds_leaks_gaps_and_strays(features, series):
    assert FT.audit_features(features, series).count() == 0
    leaked = features.withColumn(
        "oil_prod_m3_lag_1m",
        F.when((F.col("well_id") == "young") & (F.col("as_of_date") == LATER), 95.0).otherwise(F.col("oil_prod_m3_lag_1m")),
    ).filter("not (well_id = 'idle' and as_of_date = '2023-03-01')")
    found = {(r.well_id, str(r.as_of_date)): r for r in FT.audit_features(leaked, series).collect()}
    assert set(found) == {("young", LATER), ("idle", EARLIER)}
    assert found["young", LATER].diverging == ["oil_prod_m3_lag_1m"]
    assert found["idle", EARLIER].missing_in_store


def test_rolling_peak(series):
    peaks = {r.well_id: (r.recent_peak_m3, r.producing_months) for r in FT.rolling_peak(series).collect()}
    for well, known in WELLS.items():
        last = [v for _, v in sorted(known.items()) if v > 0][-12:]
        assert peaks[well] == (max(last), len(last))


def test_metadata_covers_cutoffs_without_rows(features, series):
    rows = {str(r.as_of_date): r for r in FT.materialisation_metadata(features, series, [LATER, "2020-01-01"]).collect()}
    assert rows[LATER].row_count == 4 and str(rows[LATER].source_date_end) == "2023-03-01"
    assert rows["2020-01-01"].row_count == 0 and rows["2020-01-01"].source_date_start is None


def test_many_cutoffs_need_one_shuffle_of_the_series(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.createDataFrame([("w", dt.date(2024, 1, 1), 1.0)], "well_id string, production_month date, oil_prod_m3 double").write.parquet(path)
    plan = FT.history_features(spark.read.parquet(path), ["2024-02-01", "2024-03-01"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_moments_are_exact_from_tiny_to_huge_volumes(spark):
    """Deviations and slopes equal plain rational arithmetic at every magnitude, by the build and by the audit."""
    from fractions import Fraction
    from math import sqrt

    rows, want = [], {}
    cases = {
        "tiny": ["0.0015", "0.0019"], "least": ["0.000001", "0.000002", "0.000004"], "huge": ["1000000000", "999999999.999999", "999999999.5"],
        "mixed": ["0.000001", "1000000000", "12.5"], "equal": ["0.1"] * 12, "close": [f"123456789.{k:06d}" for k in range(12)],
    }
    for well, values in cases.items():
        points = [(k + 13 - len(values), Fraction(v)) for k, v in enumerate(values)]
        rows += [(well, dt.date(2022, m, 1), v) for (m, _), v in zip(points, values)]
        n, mx, my = len(points), Fraction(sum(m for m, _ in points), len(points)), sum(y for _, y in points) / len(points)
        spread, rise = sum((y - my) ** 2 for _, y in points), sum((m - mx) * (y - my) for m, y in points)
        want[well] = (sqrt(spread / (n - 1)), float(rise / sum((m - mx) ** 2 for m, _ in points)))
    fact = spark.createDataFrame(rows, "well_id string, production_month date, oil_prod_m3 string").withColumn("oil_prod_m3", F.col("oil_prod_m3").cast("decimal(18,6)"))
    for cutoffs in ("2023-01-01", ["2023-01-01", "2023-02-01"]):
        built = {r.well_id: r for r in FT.history_features(fact, cutoffs).filter("as_of_date = '2023-01-01'").collect()}
        for well, (deviation, slope) in want.items():
            assert built[well].oil_prod_m3_roll_std_12m == pytest.approx(deviation, rel=1e-13, abs=0)
            assert built[well].oil_prod_m3_trend_12m == pytest.approx(slope, rel=1e-13, abs=1e-18)
    assert round(built["tiny"].oil_prod_m3_roll_std_12m, 6) == 0.000283


def test_audit_has_formulas_of_its_own(series, statics):
    """The two ways agree, and the audit sees a deviation that the build would repeat."""
    import inspect

    stored = FT.well_features(series, statics, [EARLIER, LATER])
    assert FT.audit_features(stored, series).count() == 0
    wrong = stored.withColumn("oil_prod_m3_roll_std_6m", F.col("oil_prod_m3_roll_std_6m") + 0.01)
    seen = FT.audit_features(wrong, series).collect()
    assert seen and all("oil_prod_m3_roll_std_6m" in r.diverging for r in seen)
    assert "_window_aggregates" not in inspect.getsource(FT.recomputed_features)


def test_tasks_follow_the_rows_of_the_panel(spark, monkeypatch):
    """Twice the wells make twice the tasks, the same rows, and no further shuffle of what was built per well."""
    from wellpanel.operators import cutoffs as CU
    from wellpanel.operators.features import history_features, recomputed_features

    panel = spark.range(40).selectExpr("concat('w', id) AS well_id", "explode(sequence(date'2020-01-01', date'2021-12-01', interval 1 month)) AS production_month", "cast(id + 1 AS decimal(18,6)) AS oil_prod_m3").localCheckpoint()
    asked = ["2021-01-01", "2021-07-01", "2022-01-01"]
    plain = {tuple(r) for r in history_features(panel, asked).collect()}
    monkeypatch.setattr(CU, "PANEL_ROWS_A_TASK", 60)
    for wells, tasks in ((20, 8), (40, 16)):
        part = panel.filter(f"cast(substr(well_id, 2) AS int) < {wells}")
        assert CU.spread_by_well(part).rdd.getNumPartitions() == tasks
    for build in (history_features, recomputed_features):
        plan = build(panel, asked)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in history_features(panel, asked).collect()} == plain and len(plain) == 120

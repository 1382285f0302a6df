from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from wellpanel.operators import backtest as B
from wellpanel.operators import metrics as M
from wellpanel.operators import supervised as SV
from wellpanel.operators.ordering import exact_quantiles, global_rank, with_position

CUT = dt.date(2026, 1, 1)
TEST_SCHEMA = (
    "as_of_date date, well_id string, horizon int, target_month date, oil_prod_m3_target double, prediction_m3 double, naive_forecast_m3 double"
)


def _test_rows(spark, naives=(12.0, 22.0, 2.0), actual=(10.0, 20.0, 0.0)):
    guess = (11.0, 18.0, 3.0)
    rows = [(CUT, "a", h + 1, dt.date(2026, h + 1, 1), actual[h], guess[h], naives[h]) for h in range(3)]
    return spark.createDataFrame(rows, TEST_SCHEMA)


def _denominator(spark, value=4.0):
    return spark.createDataFrame([(CUT, "a", value)], "as_of_date date, well_id string, insample_naive_mae_m3 double")


def test_per_well_numbers(spark):
    r = M.per_well_metrics(_test_rows(spark), _denominator(spark)).first()
    assert (r.model_mae_m3, r.naive_mae_m3, r.mase) == (2.0, 2.0, 0.5)
    assert r.model_rmse_m3 == pytest.approx(math.sqrt(14 / 3))
    assert r.mape_nonzero_pct == pytest.approx(10.0)


def test_rows_without_naive_are_not_scored(spark):
    r = M.per_well_metrics(_test_rows(spark, (12.0, 22.0, None)), _denominator(spark)).first()
    assert r.model_mae_m3 == 1.5


def test_undefined_metrics_are_null(spark):
    r = M.per_well_metrics(_test_rows(spark, actual=(0.0, 0.0, 0.0)), _denominator(spark, 0.0)).first()
    assert r.mape_nonzero_pct is None and r.mase is None


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("g", float(v), str(v)) for v in (3, 1, 4, 2)] + [("h", None, "x")], "g string, v double, k string")
    rows = exact_quantiles(df, ["g"], "v", "k", M.QUANTILES).collect()
    assert [(r.g, r.p50, round(r.p75, 6), round(r.p90, 6)) for r in rows] == [("g", 2.5, 3.25, 3.7)]


def test_quantiles_match_builtin_with_a_hot_value(spark):
    rng = random.Random(7)
    rows = [(rng.choice("xyz"), 0.0 if rng.random() < 0.4 else rng.expovariate(0.1), str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, k string").repartition(7)
    ours = {r.g: (r.p50, r.p75, r.p90) for r in exact_quantiles(df, ["g"], "v", "k", M.QUANTILES).collect()}
    exact = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("q")).collect()}
    for g in exact:
        assert ours[g] == pytest.approx(exact[g])


def test_positions_and_ranks_are_dense_and_total(spark):
    rng = random.Random(3)
    rows = [(f"w{i:05d}", None if i % 50 == 0 else float(rng.randrange(20))) for i in range(2000)]
    df = spark.createDataFrame(rows, "well_id string, total double").repartition(9)
    ranked = global_rank(df, [F.desc_nulls_last("total"), F.asc("well_id")], "r").collect()
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [r.well_id for r in sorted(ranked, key=lambda r: r.r)] == [w for w, _ in want]
    assert [r.r for r in sorted(ranked, key=lambda r: r.r)] == list(range(1, 2001))
    assert with_position(df.filter("false"), [F.asc("well_id")]).count() == 0


def test_ranking_has_no_single_task_window(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("well_id"), F.col("id").cast("double").alias("total"))
    plan = global_rank(df, [F.desc("total"), F.asc("well_id")], "r")._jdf.queryExecution().executedPlan().toString()
    # the only unpartitioned window runs over the per-partition counts
    assert plan.count("Exchange SinglePartition") == 1 and "HashAggregate" in plan


@pytest.fixture(scope="module")
def judged(features, series):
    data = SV.training_dataset(features, series, (1, 2, 3)).filter("as_of_date = '2023-04-01'")
    return data.withColumn("prediction_m3", F.col("oil_prod_m3_target")).cache()


def test_perfect_model_passes(judged, series):
    out = B.evaluate(judged, series, ["2023-04-01"])
    s = out.summary.first()
    assert (s.wells_in_test, s.wells_eligible, s.wells_excluded_short_history, s.wells_mase_undefined) == (4, 3, 1, 0)
    assert (s.arps_fitted_wells, s.arps_failed_wells, s.arps_degraded) == (2, 1, False)
    assert s.model_mae_m3 == 0.0 and s.mase_median == 0.0 and s.naive_mae_ratio == 0.0
    assert B.gates_passed(out.gates).first().gates_passed
    gates = {g.gate: g for g in out.gates.collect()}
    assert set(gates) == set(B.GATE_NAMES) and not gates["mape_vs_arps"].blocking
    metrics = {m.metric: m.value for m in out.metrics.collect()}
    assert metrics["eval_gates_passed"] == 1.0 and metrics["eval_wells_in_test"] == 4.0
    assert metrics["eval_gate_mape_vs_arps_passed"] == 1.0 and "eval_paired_mape_p50" not in metrics
    report = B.report_rows(out).first()
    assert len(report.gates) == 3 and report.thresholds.mase_median_max == 1.0


def test_bad_model_fails_the_blocking_gates(judged, series):
    bad = judged.withColumn("prediction_m3", F.col("oil_prod_m3_target") + 10_000)
    out = B.evaluate(bad, series, ["2023-04-01"], decline=False)
    assert not B.gates_passed(out.gates).first().gates_passed
    info = out.gates.filter("gate = 'mape_vs_arps'").first()
    assert info.value is None and info.passed is None and out.summary.first().arps_degraded


def test_unrepresentative_backtests_raise(judged, series):
    with pytest.raises(ValueError, match="long enough"):
        B.evaluate(judged.filter("well_id = 'young'"), series, ["2023-04-01"], decline=False)
    flat = series.withColumn("oil_prod_m3", F.lit(7.0))
    with pytest.raises(ValueError, match="scaled error"):
        B.evaluate(judged, flat, ["2023-04-01"], decline=False)


def _summary(spark, mase, model, naive, gap):
    return spark.createDataFrame(
        [(CUT, mase, model / naive if naive else None, gap)],
        "as_of_date date, mase_median double, naive_mae_ratio double, arps_mape_gap_pp double",
    )


@pytest.mark.parametrize(
    ("mase", "ratio", "gap", "want", "overall"),
    [
        (0.99, 1.0, 2.0, [True, True, True], True),
        (1.0, 0.5, 0.0, [False, True, True], False),
        (0.5, 1.0001, 0.0, [True, False, True], False),
        (0.5, 0.5, 2.1, [True, True, False], True),
        (0.5, 0.5, None, [True, True, None], True),
    ],
)
def test_gate_boundaries(spark, mase, ratio, gap, want, overall):
    gates = B.gate_rows(_summary(spark, mase, ratio, 1.0, gap))
    order = {g.gate: g.passed for g in gates.collect()}
    assert [order[n] for n in B.GATE_NAMES] == want
    assert B.gates_passed(gates).first().gates_passed is overall


def test_thresholds_are_injectable(spark):
    strict = B.Thresholds(mase_median_max=0.4)
    assert not B.gates_passed(B.gate_rows(_summary(spark, 0.5, 0.5, 1.0, None), strict)).first().gates_passed


def test_zero_naive_error(spark):
    def wells(model):
        return spark.createDataFrame(
            [(CUT, "a", 1, 1, model, 0.0, model, 0.0, None, True, True, None, 1.0, None)],
            "as_of_date date, well_id string, test_rows long, scored_rows long, abs_error_sum double, naive_abs_error_sum double, model_mae_m3 double, "
            "naive_mae_m3 double, mape_nonzero_pct double, eligible boolean, evaluable boolean, arps_fitted boolean, mase double, arps_mape_nonzero_pct double",
        )

    for model, want in ((0.0, 0.0), (3.0, float("inf"))):
        w = wells(model)
        assert B.summarise(w, B.metric_quantiles(w)).first().naive_mae_ratio == want

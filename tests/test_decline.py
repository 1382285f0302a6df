from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import months
from wellpanel.operators import decline as D

SCHEMA = "well_id string, production_month date, oil_prod_m3 double"
CUT = "2026-01-01"


def _series(spark, **wells):
    rows = []
    for name, values in wells.items():
        rows += [(name, m, float(v)) for m, v in zip(months("2010-01", "2020-12"), values)]
    return spark.createDataFrame(rows, SCHEMA)


def _forecast(fit, t):
    return fit.qi * (1 + fit.b * fit.di * t) ** (-1 / fit.b)


def test_recovers_known_declines(spark):
    t = np.arange(24)
    exponential = 500 * np.exp(-0.08 * t)
    shut_in = exponential.copy()
    shut_in[10] = 0
    h = np.arange(30)
    hyperbolic = 800 / (1 + 0.6 * 0.09 * h) ** (1 / 0.6)
    fits = {r.well_id: r for r in D.fit_declines(_series(spark, e=exponential, z=shut_in, h=hyperbolic), [CUT]).collect()}
    assert _forecast(fits["e"], 25) == pytest.approx(500 * np.exp(-0.08 * 25), rel=0.01)
    assert _forecast(fits["z"], 24) == pytest.approx(500 * np.exp(-0.08 * 24), rel=0.01)
    assert fits["h"].b == pytest.approx(0.6, abs=0.01)
    assert _forecast(fits["h"], 32) == pytest.approx(800 / (1 + 0.6 * 0.09 * 32) ** (1 / 0.6), rel=0.01)
    assert fits["z"].positive_months == 23 and fits["z"].t0_month == dt.date(2010, 1, 1)


def test_unfittable_wells_are_absent_and_rising_ones_do_not_raise(spark):
    fits = {
        r.well_id
        for r in D.fit_declines(_series(spark, few=[0] * 10 + [100] * 5, zero=[0] * 12, rising=np.linspace(10, 900, 20)), [CUT]).collect()
    }
    assert fits == {"rising"}


def test_close_to_brute_force(spark):
    rng = np.random.default_rng(5)
    wells = {f"w{k}": rng.uniform(50, 900) * np.exp(-rng.uniform(0.01, 0.1) * np.arange(40)) * rng.lognormal(0, 0.4, 40) for k in range(6)}
    fits = {r.well_id: r for r in D.fit_declines(_series(spark, **wells), [CUT]).collect()}
    b = np.linspace(1e-6, 1, 81)[:, None, None]
    di = np.concatenate([[1e-9], np.logspace(-5, 1, 300)])[None, :, None]
    t = np.arange(40.0)
    f = np.exp(-np.log1p(b * di * t) / b)
    for name, q in wells.items():
        qi = (f @ q) / (f * f).sum(-1)
        best = ((q - qi[..., None] * f) ** 2).sum(-1).min()
        assert fits[name].sse <= best * 1.001


def test_mape_uses_positive_targets_only(spark):
    fits = spark.createDataFrame(
        [(dt.date(2020, 1, 1), "a", dt.date(2019, 1, 1), 12, 100.0, 1e-9, 0.5, 0.0)],
        "as_of_date date, well_id string, t0_month date, positive_months int, qi double, di double, b double, sse double",
    )
    test = spark.createDataFrame(
        [(dt.date(2020, 1, 1), "a", dt.date(2020, 1, 1), 80.0), (dt.date(2020, 1, 1), "a", dt.date(2020, 2, 1), 0.0)],
        "as_of_date date, well_id string, target_month date, oil_prod_m3_target double",
    )
    assert D.decline_mape(test, fits).first().arps_mape_nonzero_pct == pytest.approx(25.0, rel=1e-4)
    assert D.decline_mape(test.filter("oil_prod_m3_target = 0"), fits).first().arps_mape_nonzero_pct is None


def test_inputs_respect_the_cutoff_and_chosen_wells(spark):
    s = _series(spark, a=[5, 0, 7, 8], b=[1, 2, 3, 4])
    chosen = spark.createDataFrame([(dt.date(2010, 4, 1), "a")], "as_of_date date, well_id string")
    rows = D.decline_inputs(s, ["2010-03-01", "2010-04-01"], chosen).collect()
    assert [(r.well_id, r.t, r.q) for r in rows] == [("a", [0.0, 2.0], [5.0, 7.0])]
    assert D.decline_inputs(s, ["2010-01-01"]).filter(F.col("positive_months") >= 0).count() == 0


def _noisy_wells(count: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(17)
    wells = {f"w{k}": rng.uniform(50, 900) / (1 + 0.5 * rng.uniform(0.01, 0.2) * np.arange(50)) ** 2 * rng.lognormal(0, 0.3, 50) for k in range(count)}
    wells["w0"][20:30] = 0
    wells["w1"][:45] = 0  # too few producing months
    return wells


def test_prefix_fits_equal_fits_of_each_cutoff(spark):
    cutoffs = ["2011-02-01", "2012-01-01", "2012-02-01", "2013-06-01", "2014-03-01"]
    series = _series(spark, **_noisy_wells(9))
    together = {(str(r.as_of_date), r.well_id): r for r in D.fit_declines(series, cutoffs).collect()}
    alone = {(str(r.as_of_date), r.well_id): r for c in cutoffs for r in D.fit_declines(series, [c]).collect()}
    assert together.keys() == alone.keys() and ("2014-03-01", "w1") not in together
    for key, fit in together.items():
        assert (fit.positive_months, fit.t0_month) == (alone[key].positive_months, alone[key].t0_month)
        assert fit.sse <= alone[key].sse * 1.0001


def test_chosen_pairs_only(spark):
    series = _series(spark, **_noisy_wells(4))
    chosen = spark.createDataFrame([(dt.date(2012, 1, 1), "w0"), (dt.date(2013, 1, 1), "w2"), (dt.date(2012, 1, 1), "w1")], "as_of_date date, well_id string")
    pairs = {("2012-01-01", "w0"), ("2013-01-01", "w2")}
    for fit in (D.fit_declines, D.grid_fits):
        assert {(str(r.as_of_date), r.well_id) for r in fit(series, ["2012-01-01", "2013-01-01"], chosen).collect()} == pairs


def test_grid_and_certificate(spark):
    """Grid minima equal plain numpy; every fit is certified, a spoilt one is not."""
    cutoffs = ["2012-01-01", "2013-06-01"]
    wells = _noisy_wells(6)
    series = _series(spark, **wells)
    grid = {(str(r.as_of_date), r.well_id): r for r in D.grid_fits(series, cutoffs).collect()}
    for (cut, name), r in grid.items():
        n = (int(cut[:4]) - 2010) * 12 + int(cut[5:7]) - 1
        t = np.arange(50)[:n]
        q, t = wells[name][:n][wells[name][:n] > 0], t[wells[name][:n] > 0]
        errors = []
        for b, log_di in D._CELLS:
            f = np.exp(-np.log1p(b * np.exp(log_di) * t) / b)
            errors.append((q @ q) - (f @ q) ** 2 / (f @ f))
        assert r.sse == pytest.approx(min(errors), rel=1e-9) and r.positive_months == len(q)
    fits = D.fit_declines(series, cutoffs)
    assert {r.certified for r in D.certified(fits, D.grid_fits(series, cutoffs)).collect()} == {True}
    spoilt = fits.withColumn("sse", F.col("sse") * 2)
    assert {r.certified for r in D.certified(spoilt, D.grid_fits(series, cutoffs)).collect()} == {False}


def test_grid_copies_nothing_per_cell_and_leaves_out_shapes_that_vanish(spark):
    """The rows that are shuffled are wells; a cell that is 0 over all producing months divides by nothing."""
    late = spark.createDataFrame(
        [("late", m, 0.0 if k < 90 else 100.0 - k / 2) for k, m in enumerate(months("2010-01", "2018-12"))], SCHEMA
    )
    grid = D.grid_fits(late, ["2018-01-01", "2019-01-01"])
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "cell" not in plan
    found = {str(r.as_of_date): r for r in grid.collect()}
    q = np.array([100.0 - k / 2 for k in range(90, 108)])
    for cut, n in (("2018-01-01", 6), ("2019-01-01", 18)):
        t, used = np.arange(90, 90 + n), q[:n]
        errors = []
        for b, log_di in D._CELLS:
            f = np.exp(-np.log1p(b * np.exp(log_di) * t) / b)
            if f @ f > 0:
                errors.append((used @ used) - (f @ used) ** 2 / (f @ f))
        assert found[cut].positive_months == n and found[cut].sse == pytest.approx(max(min(errors), 0), rel=1e-6, abs=1e-6)
        assert found[cut].squares == pytest.approx(used @ used)


def test_a_finished_start_leaves_the_others_running(spark):
    """Solutions of wells fitted together are those of wells fitted alone, however long their neighbours take."""
    rng = np.random.default_rng(3)
    t = np.tile(np.arange(30.0), (40, 1))
    q = rng.uniform(50, 900, (40, 1)) / (1 + rng.uniform(0.01, 0.3, (40, 1)) * t) * rng.lognormal(0, 0.5, (40, 30))
    lengths = np.tile([12, 20, 30], (40, 1))
    with np.errstate(all="ignore"):
        together = D.fit_prefixes(t, q, lengths)
        alone = np.concatenate([D.fit_prefixes(t[k : k + 1], q[k : k + 1], lengths[k : k + 1]) for k in range(40)])
        grid = D.grid_prefixes(t, q, lengths)
    assert together[..., 3] == pytest.approx(alone[..., 3], rel=1e-9)
    assert (together[..., 3] <= grid[..., 3] + 1e-9 * grid[..., 4]).all()

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import EARLIER, LATER, own_wells
from tests.plain import by_well, one_step_error, shift
from wellpanel.operators import metrics as M
from wellpanel.operators import supervised as SV

WELLS = by_well(own_wells())
CUT = dt.date.fromisoformat(LATER)


@pytest.fixture(scope="module")
def dataset(features, series):
    return SV.training_dataset(features, series, (1, 2, 3)).cache()


def test_dataset_equals_plain_python(dataset):
    rows = dataset.filter(F.col("as_of_date") == LATER).collect()
    want = {(w, h): known[shift(CUT, h - 1)] for w, known in WELLS.items() for h in (1, 2, 3) if shift(CUT, h - 1) in known}
    assert {(r.well_id, r.horizon): r.oil_prod_m3_target for r in rows} == want
    newest = {w: known[max(m for m in known if m < CUT)] for w, known in WELLS.items()}
    assert all(r.naive_forecast_m3 == newest[r.well_id] for r in rows)
    assert all(r.target_month == shift(CUT, r.horizon - 1) for r in rows)
    # an unobserved target month has no row at all
    assert ("gaps", 2) not in want


def test_horizon_bounds(features, series):
    for bad in ((), (0,), (13,)):
        with pytest.raises(ValueError):
            SV.training_dataset(features, series, bad)


def test_asof_keeps_null_of_last_row_unless_told(spark):
    s = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 5.0), ("a", dt.date(2024, 2, 1), None), ("a", dt.date(2024, 3, 1), 9.0)],
        "well_id string, production_month date, oil_prod_m3 double",
    )
    asked = spark.createDataFrame(
        [("a", dt.date(2024, 3, 1)), ("a", dt.date(2024, 4, 1)), ("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 3, 1))],
        "well_id string, as_of_date date",
    )
    by_row = {(r.well_id, r.as_of_date.month): r.v for r in SV.asof_before(asked, s, "oil_prod_m3", "v").collect()}
    assert by_row == {("a", 3): None, ("a", 4): 9.0, ("a", 1): None, ("b", 3): None}
    by_value = {(r.well_id, r.as_of_date.month): r.v for r in SV.asof_before(asked, s, "oil_prod_m3", "v", skip_nulls=True).collect()}
    assert by_value == {("a", 3): 5.0, ("a", 4): 9.0, ("a", 1): None, ("b", 3): None}


def test_split_is_chronological(dataset):
    split = SV.temporal_split(dataset, LATER)
    found = {(str(r.as_of_date), r.split) for r in split.select("as_of_date", "split").distinct().collect()}
    assert found == {(EARLIER, "train"), (LATER, "test")}
    with pytest.raises(ValueError, match="nothing to evaluate"):
        SV.temporal_split(dataset, "2023-05-01")
    with pytest.raises(ValueError, match="nothing to train on"):
        SV.temporal_split(dataset, EARLIER)
    with pytest.raises(ValueError, match="nothing to train on"):
        SV.temporal_split(dataset, LATER, validation_cutoffs=1)


def test_purge_drops_training_targets_of_the_tested_period(dataset):
    plain = SV.temporal_split(dataset, LATER).filter("split = 'train'")
    purged = SV.temporal_split(dataset, LATER, purge_overlap=True).filter("split = 'train'")
    earlier = shift(CUT, -1)
    kept = [(w, h) for w, known in WELLS.items() for h in (1, 2, 3) if shift(earlier, h - 1) in known]
    inside = [(w, h) for w, h in kept if h > 1]
    assert plain.filter(F.col("target_month") >= LATER).count() == len(inside)
    assert plain.count() == len(kept) and purged.count() == len(kept) - len(inside)


def test_footprint(dataset):
    r = SV.dataset_footprint(dataset).first()
    assert (r.rows, r.wells, r.horizons) == (dataset.count(), 4, [1, 2, 3])
    assert [str(c) for c in r.cutoffs] == [EARLIER, LATER]


def test_one_step_naive_and_eligibility(series):
    found = {r.well_id: r.insample_naive_mae_m3 for r in M.one_step_naive_mae(series, [LATER]).collect()}
    assert found == pytest.approx({w: one_step_error(known, CUT) for w, known in WELLS.items()}, rel=1e-9)
    eligible = {r.well_id for r in M.eligible_wells(series, [LATER]).collect()}
    assert eligible == {"shutin", "gaps", "idle"}


def test_single_observation_has_no_denominator(spark):
    s = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0)], "well_id string, production_month date, oil_prod_m3 double")
    assert M.one_step_naive_mae(s, ["2024-06-01"]).count() == 0


def test_expand_and_dataset_order(features, dataset):
    assert SV.expand_horizons(features, range(1, 13)).count() == 96
    keys = [(r.as_of_date, r.well_id, r.horizon) for r in SV.dataset_order(dataset).collect()]
    assert keys == sorted(keys)
    assert dataset.filter(F.col("oil_prod_m3_target").isNull()).count() == 0


def test_targets_are_never_broadcast(features, series, dataset):
    """Their size before the expansion says nothing about the rows that every task would hold."""
    wanted = {(r.well_id, r.as_of_date, r.horizon) for r in dataset.collect()}
    joined = features.select("well_id", "as_of_date").join(SV.targets_by_cutoff(series, (1, 2, 3)), ["well_id", "as_of_date"])
    counted = SV.training_dataset(features, series, (1, 2, 3)).groupBy("as_of_date").count()
    for df in (joined, counted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        top = next(line for line in plan.splitlines() if "Join" in line)
        assert "SortMergeJoin" in top, top
    assert {(r.well_id, r.as_of_date, r.horizon) for r in joined.collect()} == wanted

from __future__ import annotations

import datetime as dt
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import own_wells
from tests.plain import by_well, shift
from tests.test_layers import REG_NAMES, frame, raw_row
from wellpanel.operators import champion as CH
from wellpanel.operators import model as MD
from wellpanel.operators import quality as Q
from wellpanel.operators.features import audit_features
from wellpanel.plans import monthly as P
from wellpanel.plans.retraining import retrain, run_record
from wellpanel.sources import published as PB


def _checks():
    return Q.typed_production_checks("2014-05-01")


def test_monthly_build_upserts_and_blocks(spark, tmp_path):
    lake = P.Lake(str(tmp_path / "lake"))
    registry = frame(spark, [("1", "C", "", "", "", "R-1", "", "F", "B", "", "", "", "", "1")], REG_NAMES)
    full = {"prod_agua": "1"}
    first = frame(spark, [raw_row(well=w, mon=str(m), oil=str(m), **full) for w in ("1", "2") for m in (1, 2, 3)])
    P.run_month(spark, first, registry, lake, version=0, run="2014-04", checks=_checks(), cutoffs=["2014-03-01", "2014-04-01"])
    fact = PB.read_current(spark, lake.path("gold", "fact_production"))
    assert fact.count() == 6

    # well 2 vanishes from month 3: gone from the typed table, kept in the fact
    second = frame(spark, [raw_row(well="1", mon="3", oil="30", load="2", **full), raw_row(well="1", mon="4", oil="4", load="2", **full)])
    P.run_month(spark, second, registry, lake, version=1, run="2014-05", checks=_checks(), cutoffs=["2014-04-01", "2014-05-01"],
                start="2014-03-01", end="2014-05-01")
    silver = PB.read_current(spark, lake.path("silver", "production"))
    fact = PB.read_current(spark, lake.path("gold", "fact_production"))
    assert silver.filter("production_month = '2014-03-01'").count() == 1
    assert {(r.well_id, float(r.oil_prod_m3)) for r in fact.filter("production_month = '2014-03-01'").collect()} == {("1", 30.0), ("2", 3.0)}
    features = PB.read_current(spark, lake.path("features", "well_features"), "as_of_date")
    assert {str(r[0]): r[1] for r in features.groupBy("as_of_date").count().collect()} == {"2014-03-01": 2, "2014-04-01": 2, "2014-05-01": 2}
    assert audit_features(features, fact).count() == 0

    bad = frame(spark, [raw_row(well="1", mon="5", company=None, **full)])
    with pytest.raises(Q.QualityError, match="not_null_company_id"):
        P.run_month(spark, bad, registry, lake, version=2, run="2014-06", checks=_checks(), cutoffs=["2014-06-01"], start="2014-05-01", end="2014-06-01")
    assert PB.read_current(spark, lake.path("gold", "fact_production")).count() == 7
    silver = PB.read_current(spark, lake.path("silver", "production"))
    assert silver.filter("production_month = '2014-05-01'").isEmpty() and silver.count() == 6  # the failing month was never published
    scratch = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not list(scratch.glob("month-2014-0*"))
    kept = spark.read.parquet(lake.path("silver", "quality_failures"))
    assert kept.filter("run = '2014-06' and check_name = 'not_null_company_id'").count() == 1


def test_a_broken_layer_stops_what_follows(spark, tmp_path, monkeypatch):
    lake = P.Lake(str(tmp_path / "lake"))
    registry = frame(spark, [("1", "C", "", "", "", "R-1", "", "F", "B", "", "", "", "", "1")], REG_NAMES)
    rows = frame(spark, [raw_row(well="1", mon=str(m), oil=str(m), prod_agua="1") for m in (1, 2, 3)])
    whole = P.ST.dim_company
    monkeypatch.setattr(P.ST, "dim_company", lambda production: whole(production).limit(0))
    with pytest.raises(Q.QualityError, match="relationships_company_key"):
        P.run_month(spark, rows, registry, lake, version=0, run="one", checks=_checks(), cutoffs=["2014-04-01"])
    results = spark.read.parquet(lake.path("silver", "quality_results"))
    assert {r.table_name for r in results.collect()} == {"typed_production", "typed_registry", "dim_well", "dim_company", "dim_date", "fact_production"}
    assert not (tmp_path / "lake" / "gold" / "fact_production").exists() and not (tmp_path / "lake" / "features").exists()
    monkeypatch.setattr(P.ST, "dim_company", whole)
    leaky = P.FT.well_features
    monkeypatch.setattr(P.FT, "well_features", lambda *a: leaky(*a).withColumn("oil_prod_m3_lag_1m", F.lit(99.0)))
    with pytest.raises(Q.QualityError, match="point_in_time"):
        P.run_month(spark, rows, registry, lake, version=0, run="two", checks=_checks(), cutoffs=["2014-04-01"])
    assert not (tmp_path / "lake" / "features").exists()


def test_stored_cutoffs_follow_changes_of_the_fact(spark, tmp_path, monkeypatch):
    """Months revised or delivered late move the cutoffs nobody asked for, also after a run that broke off in between."""
    lake = P.Lake(str(tmp_path / "lake"))
    registry = frame(spark, [(w, "C", "", "", "", f"R-{w}", "", "F", "B", "", "", "", "", w) for w in ("1", "2", "3")], REG_NAMES)

    def rows(*declared):
        return frame(spark, [raw_row(well=w, mon=str(m), oil=str(v), load=str(k), prod_agua="1") for w, m, v, k in declared])

    def audited():
        fact = PB.read_current(spark, lake.path("gold", "fact_production"))
        features = PB.read_current(spark, lake.path("features", "well_features"), "as_of_date")
        assert audit_features(features, fact).count() == 0
        return {(r.well_id, str(r.as_of_date)): r.oil_prod_m3_lag_1m for r in features.collect()}

    common = {"spark": spark, "raw_registry": registry, "lake": lake, "checks": _checks()}
    first = rows(*[(w, m, 10 * m, 1) for w in ("1", "2") for m in (1, 2)])
    P.run_month(raw=first, version=0, run="a", cutoffs=["2014-02-01", "2014-03-01"], **common)
    assert audited()["1", "2014-03-01"] == 20.0

    built = P.build_features
    monkeypatch.setattr(P, "build_features", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        P.run_month(raw=rows(("1", 2, 77, 2), ("2", 2, 20, 2)), version=1, run="b", cutoffs=["2014-04-01"], start="2014-02-01", end="2014-03-01", **common)
    monkeypatch.setattr(P, "build_features", built)
    late = rows(("1", 3, 30, 3), ("2", 3, 30, 3), ("3", 3, 5, 3))
    P.run_month(raw=late, version=2, run="c", cutoffs=["2014-04-01"], start="2014-03-01", end="2014-04-01", **common)
    found = audited()
    assert found["1", "2014-03-01"] == 77.0 and found["1", "2014-02-01"] == 10.0
    assert {c for w, c in found if w == "3"} == {"2014-04-01"} and len(found) == 7
    state = PB.current(spark, lake.path("features", "well_features"), "as_of_date")
    # the cutoff that nothing reached keeps the file of the first run
    assert dict(state.batches) == {"2014-02-01": 1, "2014-03-01": 2, "2014-04-01": 2}
    assert state.made_from == f"{PB.current(spark, lake.path('gold', 'fact_production')).version}/2"


def test_retraining_chain(spark, features, series):
    stored = features.drop("feature_key")
    out = retrain(stored, series, "2023-04-01", spec=MD.ModelSpec(kind="linear"))
    pooled = out.pooled.first()
    earlier, cut = dt.date(2023, 3, 1), dt.date(2023, 4, 1)
    wells = by_well(own_wells())

    def observed(at):
        return [(w, shift(at, h)) for w in wells for h in range(3) if shift(at, h) in wells[w]]

    assert (pooled.train_rows, pooled.validation_rows, pooled.test_rows) == (len(observed(earlier)), 0, len(observed(cut)))
    last = {w: known[max(m for m in known if m < cut)] for w, known in wells.items()}
    assert pooled.naive_mae_m3 == pytest.approx(statistics.mean(abs(wells[w][m] - last[w]) for w, m in observed(cut)))
    assert out.footprint.first().rows == len(observed(earlier)) + len(observed(cut))
    history = run_record(out, model="oil", version="1", run_id="r1", registered_at=dt.datetime(2023, 5, 1))
    row = CH.with_decision(CH.registered_versions(history)).first()
    assert row.decision == ("promotable" if row.gates_passed else "rejected") and row.metrics["eval_wells_in_test"] == 4.0
    assert out.backtest.wells.filter(F.col("evaluable")).count() == 3


def test_evidence_is_looked_for_only_where_a_check_found_something(spark, tmp_path, monkeypatch):
    """F8, F9: the search for repeated keys shuffled whole rows of tables that had just passed the check."""
    lake, asked, real = P.Lake(str(tmp_path / "lake")), [], Q.failing_rows
    monkeypatch.setattr(Q, "failing_rows", lambda rows, checks, *more: (asked.append([c.name for c in checks]), real(rows, checks, *more))[1])
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", None)], "well_id string, oil double")
    checks = [Q.not_null("well_id"), Q.unique("well_id", severity=Q.WARN), Q.unique("well_id", "oil"), Q.accepted_range("oil", 0), Q.not_null_share("oil", severity=Q.WARN)]
    for run, table, want in (("good", rows.filter("oil < 3"), []), ("bad", rows, ["unique_well_id", "not_null_share_oil"])):
        P._gate(lake, run, "t", table, checks, ["well_id"])
        kept = spark.read.parquet(f"{lake.path('silver', 'quality_failures')}/run={run}/checked=t")
        assert kept.columns == ["table_name", "check_name", "dimension", "severity", "well_id", "row_json"]
        assert asked.pop() == want
        assert sorted((r.check_name, r.well_id) for r in kept.collect()) == ([("unique_well_id", "b")] * 2 if want else [])

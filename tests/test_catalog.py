"""A cross-section of the registered queries against their SQL, at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ("f01_typed_production", "f08_top_wells", "f10_well_features", "f11_training_dataset", "f21_multi_cutoff", "j06_asof_backward", "q13_failed_checks", "r03_latency_histogram_stream")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    _, rows, diff = compare(spark, connect(SF_DIR), SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert rows > 0 and diff == ""


def test_every_sql_form_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_features_are_planned_once(spark):
    """The dataset reads stored features: their windows and aggregations stand in no plan of it."""
    from wellpanel.plans.catalog import Panel

    panel = Panel(spark, SF_DIR)
    for df in (panel.dataset, panel.tested):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("oil_prod_m3_roll_std_12m") and "sqrt" not in plan.lower()


def test_entry_survives_a_package_that_only_the_training_operators_need(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.split(".")[0] in ("corpus_pipeline", "zstandard"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert len(entry.queries()) > 150 and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_a_build_audits_its_features_once(spark, monkeypatch):
    """The check and its evidence read stored audit rows: no window or aggregation of the audit stands in their plans."""
    from wellpanel.operators import quality as Q
    from wellpanel.plans.catalog import QUERIES

    plans, real = [], Q.absent_from

    def seen(name, keys, wrong):
        plans.append(wrong._jdf.queryExecution().optimizedPlan().toString())
        return real(name, keys, wrong)

    monkeypatch.setattr(Q, "absent_from", seen)
    QUERIES["b01_quality_results"](spark, SF_DIR)
    # the second is the query's own audit of a damaged copy
    assert len(plans) == 2 and "Window" not in plans[0] and "Window" in plans[1]

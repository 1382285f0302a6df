from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import month
from wellpanel.operators import quality as Q
from wellpanel.operators import reports as R
from wellpanel.operators import star as ST
from wellpanel.schema import FLUID_LABELS, PRODUCTION_SCHEMA


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("a", month("2024-01"), 5.0), ("a", month("2024-01"), 6.0), ("b", month("2024-01"), -1.0),
        (None, month("2024-02"), 1.0), ("c", month("2005-01"), None), ("c", month("2024-02"), 2.0),
    ]
    return spark.createDataFrame(rows, "well_id string, production_month date, oil double").cache()


def checks():
    return [
        Q.not_null("well_id"), Q.accepted_range("oil", 0), Q.accepted_range("production_month", Q.FIRST_MONTH),
        Q.unique("well_id", "production_month"), Q.unique("well_id"), Q.not_null_share("oil", 0.9), Q.not_null_share("oil", 0.8),
        Q.recency("production_month", "2024-04-01"), Q.recency("production_month", "2024-04-02"),
    ]


def test_results_of_every_kind(table):
    rows = Q.run_checks(table, checks(), "t").collect()
    got = sorted((r.check_name, r.failing_rows, r.passed, r.severity) for r in rows)
    assert got == sorted(
        [
            ("not_null_well_id", 1, False, "error"), ("accepted_range_oil", 1, False, "error"), ("accepted_range_production_month", 1, False, "error"),
            ("unique_well_id_production_month", 2, False, "error"), ("unique_well_id", 4, False, "error"), ("not_null_share_oil", 1, False, "error"),
            ("not_null_share_oil", 0, True, "error"), ("recency_production_month", 0, True, "warn"), ("recency_production_month", 1, False, "warn"),
        ]
    )
    assert {r.total_rows for r in rows} == {6}
    assert Q.failed_checks(Q.run_checks(table, checks(), "t")).count() == 7


def test_only_errors_block(table):
    stale = Q.run_checks(table, [Q.recency("production_month", "2030-01-01")], "t")
    Q.require_passed(stale)
    with pytest.raises(Q.QualityError, match="accepted_range_oil"):
        Q.require_passed(Q.run_checks(table, [Q.accepted_range("oil", 0)], "t"))


def test_every_published_check_blocks_except_recency(spark):
    assert {c.name for c in Q.typed_production_checks("2024-01-01") if c.severity == Q.WARN} == {"recency_production_month"}


def test_evidence_share_and_fitness(table):
    failures = Q.failing_rows(table, checks()[:4], "t", ["well_id", "production_month"])
    found = sorted((r.check_name, r.well_id, r.production_month) for r in failures.collect() if r.well_id)
    assert found == [
        ("accepted_range_oil", "b", "2024-01-01"), ("accepted_range_production_month", "c", "2005-01-01"),
        ("unique_well_id_production_month", "a", "2024-01-01"), ("unique_well_id_production_month", "a", "2024-01-01"),
    ]
    assert '"oil":-1.0' in failures.filter("check_name = 'accepted_range_oil'").first().row_json
    share = {(str(r.production_month), r.dimension): r.failing_pct for r in Q.failing_share(failures, table).collect()}
    assert share["2024-01-01", "range"] == 33.33
    fit = {str(r.production_month): r.fitness for r in Q.fitness(failures, table).collect()}
    assert fit == {"2024-01-01": "unfit", "2005-01-01": "unfit", "2024-02-01": "unfit"}
    few = failures.filter("check_name = 'accepted_range_oil'")
    assert {str(r.production_month): r.fitness for r in Q.fitness(few, table, max_pct=50.0).collect()}["2024-01-01"] == "fit_with_remark"
    assert Q.evidence_sample(failures, "2024-01-01", limit=1).count() == 1


def test_failures_without_a_period_are_kept(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", None, 2.0), ("c", month("2024-03"), 1.0), ("c", month("2024-04"), 1.0)], "well_id string, production_month date, oil double")
    failures = Q.failing_rows(rows, [Q.not_null("production_month"), Q.unique("well_id")], "t", ["well_id", "production_month"])
    fit = {str(r.production_month): (r.failing_rows, r.fitness) for r in Q.fitness(failures, rows).collect()}
    assert fit == {"None": (2, "unfit"), "2024-03-01": (1, "unfit"), "2024-04-01": (1, "unfit")}
    share = {(str(r.production_month), r.dimension): r.failing_pct for r in Q.failing_share(failures, rows).collect()}
    assert share == {("None", "completeness"): 100.0, ("2024-03-01", "uniqueness"): 100.0, ("2024-04-01", "uniqueness"): 100.0}


def test_relationships_ignore_null_keys(spark, table):
    parent = spark.createDataFrame([("a",), ("b",)], "well_id string")
    assert Q.run_checks(table, [Q.references("well_id", parent)], "t").first().failing_rows == 2
    assert Q.orphans(table, "well_id", parent).count() == 2


def test_schema_contract_lists_every_difference(spark):
    df = spark.createDataFrame([], PRODUCTION_SCHEMA)
    assert Q.require_schema(df.select(*reversed(df.columns)), PRODUCTION_SCHEMA).columns == PRODUCTION_SCHEMA.fieldNames()
    bad = df.drop("basin").withColumn("extra", F.lit(1)).withColumn("oil_prod_m3", F.lit("x"))
    with pytest.raises(Q.ContractError) as e:
        Q.require_schema(bad, PRODUCTION_SCHEMA)
    assert all(part in str(e.value) for part in ("missing basin", "unexpected extra", "oil_prod_m3 is string"))


def test_feature_contract_reports_all_violations(features):
    ok = features.drop("feature_key")
    assert Q.feature_contract_violations(ok) == []
    bad = ok.drop("basin").withColumn("extra", F.lit(1)).withColumn("oil_prod_m3_lag_1m", F.lit("x"))
    found = Q.feature_contract_violations(bad.unionByName(bad))
    assert {(v.kind, v.column) for v in found} == {
        ("absent", "basin"), ("extra", "extra"), ("type", "oil_prod_m3_lag_1m"), ("repeated_key", "well_id+as_of_date")
    }
    with pytest.raises(Q.ContractError):
        Q.require_feature_contract(bad)


def test_profile(table):
    rows = {r.column_name: r for r in Q.profile(table).collect()}
    assert (rows["well_id"].null_count, rows["well_id"].distinct_count, rows["well_id"].min_value, rows["well_id"].max_value) == (1, 3, "a", "c")
    assert (rows["oil"].distinct_count, rows["oil"].min_value, rows["oil"].row_count) == (5, "-1.000000", 6)


def test_profile_covers_every_column(spark):
    wide = spark.range(7).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(60)])
    found = {r.column_name: r.distinct_count for r in Q.profile(wide).collect()}
    assert found == {f"c{k}": min(k + 1, 7) for k in range(60)}


@pytest.fixture(scope="module")
def star(spark):
    rows = [
        ("w1", "c1", month("2024-01"), 10, 1, None), ("w1", "c1", month("2024-02"), 20, 2, 5), ("w2", "c2", month("2024-02"), None, 3, 7), ("w3", "c2", month("2024-02"), 1, 1, 1),
    ]
    p = spark.createDataFrame(
        [(w, c, m, *[None if v is None else float(v) for v in vs]) for w, c, m, *vs in rows],
        "well_id string, company_id string, production_month date, oil_prod_m3 double, gas_prod_mm3 double, water_prod_m3 double",
    )
    p = p.withColumn("company_name", F.concat(F.lit("name "), "company_id"))
    fact = ST.fact_production(p).cache()
    wells = fact.select("well_key", "well_id").distinct().withColumn("well_alias", F.when(F.col("well_id") == "w3", "Alias-w2").otherwise(F.concat(F.lit("Alias-"), "well_id")))
    return fact, wells, ST.dim_company(p), ST.dim_date(p)


def test_fluid_questions(star):
    fact, wells, companies, dates = star
    rows = R.production_by_fluid(fact, wells, companies, dates).collect()
    assert len(rows) == 12 and sum(r.volume is None for r in rows) == 2
    one = R.production_by_fluid(fact, wells, companies, dates, well_name="ALIAS-W1", month="2024-02-01", fluid="Agua").collect()
    assert [(r.well_alias, r.company_name, r.volume) for r in one] == [("Alias-w1", "name c1", 5.0)]
    history = {(str(r.production_month), r.fluid_type): r.total_volume for r in R.history_by_fluid(fact, dates, since="2024-02-01").collect()}
    assert history == {("2024-02-01", "Petróleo"): 21.0, ("2024-02-01", "Gas"): 6.0, ("2024-02-01", "Agua"): 13.0}
    top = [(r.well_alias, r.fluid_type, r.total_volume) for r in R.top_by_fluid(fact, wells, limit=2).collect()]
    assert top == [("Alias-w1", "Petróleo", 30.0), ("Alias-w2", "Agua", 8.0)]
    assert R.top_by_fluid(fact, wells, fluid="none").count() == 0
    ordered = [r.production_month for r in R.production_order(R.production_by_fluid(fact, wells, companies, dates)).collect()]
    assert ordered == sorted(ordered, reverse=True)
    assert list(FLUID_LABELS.values()) == ["Petróleo", "Gas", "Agua"]


def test_wanted_fluid_prunes_the_other_measures(spark, star, tmp_path):
    fact, _, _, dates = star
    path = str(tmp_path / "fact")
    fact.write.parquet(path)
    plan = R.history_by_fluid(spark.read.parquet(path), dates, fluid="Gas")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "gas_prod_mm3" in schema and "oil_prod_m3" not in schema and "water_prod_m3" not in schema


def test_serving_reads(spark, star):
    fact, wells, *_ = star
    asked = spark.createDataFrame(
        [("w1", month("2024-01"), month("2024-02")), ("w2", month("2024-02"), month("2024-02")), ("zz", month("2024-01"), month("2024-02"))],
        "well_id string, date_start date, date_end date",
    )
    rows = {(r.well_id, r.date.month): r["prod"] for r in R.production_window(asked, fact).collect()}
    assert rows == {("w1", 1): 10.0, ("w1", 2): 20.0, ("w2", 2): 0.0}
    assert R.known_wells(asked, wells).count() == 2
    assert [r.well_id for r in R.well_list(wells).collect()] == ["w1", "w2", "w3"]
    reversed_dates = spark.createDataFrame([("w1", dt.date(2024, 2, 1), dt.date(2024, 1, 1))], asked.schema)
    with pytest.raises(PySparkException, match="date_start must be before date_end"):
        R.production_window(reversed_dates, fact).collect()


def test_control_totals(star):
    rows = R.control_totals(star[0], "2024-02-01", "2024-03-01").collect()
    assert [(str(r.production_month), r.n_rows, r.oil_prod_m3) for r in rows] == [("2024-02-01", 3, 21.0)]

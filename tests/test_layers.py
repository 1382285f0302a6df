from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import month
from wellpanel.functions import columns as C
from wellpanel.operators import star as ST
from wellpanel.operators import typed as TY
from wellpanel.schema import NUMERIC, PRODUCTION_SCHEMA
from wellpanel.sources import raw as RAW
from wellpanel.sources import tables as TB

RAW_NAMES = (
    "idempresa anio mes idpozo prod_pet prod_gas prod_agua empresa sigla formacion areayacimiento cuenca provincia tipo_de_recurso _dlt_load_id"
).split()
REG_NAMES = (
    "idpozo idempresa profundidad coordenaday coordenadax sigla formprod areayacimiento cuenca provincia clasificacion subclasificacion tipo_reservorio _dlt_load_id"
).split()


def raw_row(well="77", year="2014", mon="1", oil="10.5", load="1", company="NOR", name="NORTHERN OIL", alias="N-1", **more):
    base = dict(zip(RAW_NAMES, (company, year, mon, well, oil, "0.000", "", name, alias, "lower sand", "", "NEUQUINA", "Neuquén", "CONVENCIONAL", load)))
    return tuple({**base, **more}[n] for n in RAW_NAMES)


def frame(spark, rows, names=RAW_NAMES):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def silver(spark):
    rows = [raw_row(mon=str(m), oil=v) for m, v in ((1, "10"), (2, "0.000"), (3, " "), (4, "-3"), (5, "7.25"))]
    rows += [raw_row(oil="99", load="2"), raw_row(year=" ", oil="1"), raw_row(well="2", mon="5", alias="", name="", company="Z")]
    return TY.typed_production(frame(spark, rows)).cache()


def test_typing_cleaning_and_latest_load(silver):
    assert silver.schema.fieldNames() == PRODUCTION_SCHEMA.fieldNames()
    got = {(r.well_id, r.production_month.month): r.oil_prod_m3 for r in silver.collect()}
    assert {k: None if v is None else float(v) for k, v in got.items()} == {
        ("77", 1): 99.0, ("77", 2): 0.0, ("77", 3): None, ("77", 4): None, ("77", 5): 7.25, ("2", 5): 10.5,
    }
    r = silver.filter("well_id = '2'").first()
    assert r.well_alias is None and r.company_name is None and r.field is None and r.province == "Neuquén"
    assert r.water_prod_m3 is None and r.gas_prod_mm3 == 0


def test_range_and_bad_month(spark):
    rows = [raw_row(mon=str(m)) for m in range(1, 13)]
    kept = TY.typed_production(frame(spark, rows), "2014-03-01", "2014-06-01")
    assert sorted(r.production_month.month for r in kept.collect()) == [3, 4, 5]
    with pytest.raises(PySparkException):
        TY.typed_production(frame(spark, [raw_row(mon="13")])).collect()


def test_deduplication_limits_groups_before_the_shuffle(spark):
    plan = TY.typed_production(frame(spark, [raw_row()]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        ("88", "NOR", "3025.00", "-38.5", "-68.7", "R-88a", "upper shale", "F", "NEUQUINA", "Neuquén", "EXPLOTACION", "", "CONV", "1"),
        ("88", "NOR", "", "-38.5", "-68.7", "R-88b", "upper shale", "F", "NEUQUINA", "Neuquén", "EXPLOTACION", "", "CONV", "2"),
        (" ", "X", "", "", "", "", "", "", "", "", "", "", "", "3"),
        ("2", "Z", "5", "", "", "ALIAS-2", "", "REGISTRY FIELD", "", "", "", "", "", "1"),
    ]
    return TY.typed_registry(frame(spark, rows, REG_NAMES))


def test_dimensions_and_fact_resolve(silver, registry):
    wells = {r.well_id: r for r in ST.dim_well(registry, silver).collect()}
    assert set(wells) == {"88", "2", "77"} == {r.well_id for r in ST.well_universe(registry, silver).collect()}
    assert wells["2"].well_alias == "ALIAS-2" and wells["2"].field == "REGISTRY FIELD" and wells["2"].basin == "NEUQUINA"
    assert wells["88"].well_alias == "R-88b" and wells["88"].depth_m is None and wells["88"].formation is None
    assert wells["77"].formation == "lower sand"
    companies = {r.company_id: r.company_name for r in ST.dim_company(silver).collect()}
    assert companies == {"NOR": "NORTHERN OIL", "Z": None}
    dates = ST.dim_date(silver)
    d = dates.filter("month = 5").first()
    assert (d.year, d.quarter, d.month_name) == (2014, 2, "May")
    fact = ST.fact_production(silver)
    view = ST.monthly_production_by_well(fact, ST.dim_well(registry, silver), ST.dim_company(silver), dates)
    assert view.count() == silver.count() == 6


def test_company_name_null_goes_last(spark):
    rows = [("C", None), ("C", "B"), ("C", "A"), ("D", None), (None, "x")]
    df = spark.createDataFrame(rows, "company_id string, company_name string")
    assert {r.company_id: r.company_name for r in ST.dim_company(df).collect()} == {"C": "A", "D": None}


def test_company_names_are_hashed_before_any_sort(spark, tmp_path):
    path = str(tmp_path / "silver")
    spark.createDataFrame([("C", "A")], "company_id string, company_name string").write.parquet(path)
    plan = ST.dim_company(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "Sort" in line or "HashAggregate" in line]
    assert "HashAggregate" in lines[-1] and "partial_count" in lines[-1]


def test_top_wells_puts_wells_without_oil_last(silver, registry):
    rows = ST.top_wells_by_volume(ST.fact_production(silver), ST.dim_well(registry, silver)).orderBy("oil_volume_rank").collect()
    assert [(r.well_id, r.oil_volume_rank) for r in rows] == [("77", 1), ("2", 2)]


def test_csv_scan_keeps_text_and_cleans_header(spark, tmp_path):
    text = '﻿idpozo, prod_pet ,,empresa\n1,0.000,zz,"A ""q"" S.A.\nline two"\n2,,zz,Neuquén\n3\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    df = RAW.ingest_csv(spark, str(tmp_path / "a.csv"), source="production_by_well", partition_key="2016-01-01", load_id="7")
    assert df.columns == ["idpozo", "prod_pet", "empresa", "_source_name", "_partition_key", "_dlt_load_id"]
    rows = {r.idpozo: r for r in df.collect()}
    assert rows["1"].prod_pet == "0.000" and rows["1"].empresa == 'A "q" S.A.\nline two'
    assert rows["2"].prod_pet == "" and rows["2"].empresa == "Neuquén" and rows["3"].empresa == ""
    assert rows["1"]._partition_key == "2016-01-01" and rows["1"]._dlt_load_id == "7"


def test_operational_month():
    assert RAW.operational_month("2020-01-01", "x") == "2020-01-01"
    assert RAW.operational_month(None, "2020-02-01") == "2020-02-01"
    assert RAW.operational_month(today=dt.date(2020, 3, 17)) == "2020-03-01"


def test_seed_and_extracts(spark, tmp_path):
    seed = RAW.typed_seed_events(RAW.seed_events(spark), "9").first()
    assert seed.production_month == dt.date(2026, 6, 1) and seed.dlt_load_id == "9"
    (tmp_path / "s.csv").write_text("well_id,production_month,oil_prod_m3\n007,2024-01-01,1.5\n")
    r = RAW.read_series_extract(spark, str(tmp_path / "s.csv")).first()
    assert r.well_id == "007" and r.production_month == dt.date(2024, 1, 1) and r.oil_prod_m3 == 1.5


SCHEMA = "well_id string, production_month date, v int"


def _read(spark, path):
    return {(r.well_id, r.production_month.month): r.v for r in TB.read_table(spark, path).collect()}


def test_replace_periods_and_upsert_differ_on_vanished_rows(spark, tmp_path):
    a, b = str(tmp_path / "periods"), str(tmp_path / "upsert")
    first = spark.createDataFrame([("x", month("2024-01"), 1), ("y", month("2024-01"), 2), ("x", month("2024-02"), 3)], SCHEMA)
    second = spark.createDataFrame([("x", month("2024-01"), 10), ("z", month("2024-03"), 4)], SCHEMA)
    for path in (a, b):
        assert TB.read_table(spark, path) is None
    TB.replace_periods(first, a)
    TB.upsert_periods(spark, first, b, ["well_id"])
    for _ in range(2):  # a rerun changes nothing
        TB.replace_periods(second, a)
        TB.upsert_periods(spark, second, b, ["well_id"])
        assert _read(spark, a) == {("x", 1): 10, ("x", 2): 3, ("z", 3): 4}
        assert _read(spark, b) == {("x", 1): 10, ("y", 1): 2, ("x", 2): 3, ("z", 3): 4}


def test_versioned_dimension_upsert_keeps_vanished_keys_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "dim")
    TB.upsert_dimension(spark, spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), path, ["k"], 0)
    out = TB.upsert_dimension(spark, spark.createDataFrame([("b", 2, "new")], "k string, v int, w string"), path, ["k"], 1)
    assert {(r.k, r.v, r.w) for r in out.collect()} == {("a", 1, None), ("b", 2, "new")}
    assert TB.read_version(spark, path, 0).count() == 2


def test_drift_and_layers(spark):
    old = spark.createDataFrame([(1,)], "a int")
    new = spark.createDataFrame([(2, "x")], "a int, b string")
    assert {(r.a, r.b) for r in TB.append_with_drift(old, new).collect()} == {(1, None), (2, "x")}
    assert TB.layer_path("/lake/", "gold", "t") == "/lake/gold/t"
    with pytest.raises(ValueError):
        TB.layer_path("/lake", "platinum", "t")


def test_training_frames_guard_empty_input(features, series):
    f, s = TB.training_frames(features, series, "2023-03-01")
    assert f.count() == 4 and s.count() == series.count()
    with pytest.raises(ValueError, match="no stored features"):
        TB.training_frames(features, series, "2020-01-01")
    with pytest.raises(ValueError, match="fact is empty"):
        TB.training_frames(features, series.filter("false"), "2023-04-01")


def test_column_helpers(spark):
    df = spark.createDataFrame([("2024-11-17", "2023-02-01", " 12x", None, 1.0)], "d string, e string, t string, n string, x double").select(
        F.col("d").cast("date").alias("d"), F.col("e").cast("date").alias("e"), "t", "n", "x"
    )
    r = df.select(
        C.shift_months("d", 3).alias("shift"), C.months_between_int("d", "e").alias("gap"), C.lenient("t", NUMERIC).alias("lenient"),
        C.surrogate_key("t", "n").alias("key"), C.differs(F.col("n"), F.col("t")).alias("ne"), C.differs(F.col("n"), F.col("n")).alias("eq"),
        C.differs_beyond(F.col("x"), F.col("x") + 1e-7).alias("near"), C.differs_beyond(F.col("x"), F.lit(None).cast("double")).alias("gone"),
        C.contains_text("t", "2X").alias("has"),
    ).first()
    assert r.shift == dt.date(2025, 2, 1) and r.gap == 21 and r.lenient is None and len(r.key) == 32
    assert (r.ne, r.eq, r.near, r.gone, r.has) == (True, False, False, True, True)
    with pytest.raises(PySparkException):
        df.select(C.strict("t", NUMERIC)).collect()


def test_range_rebuild_reads_only_its_months(spark, tmp_path):
    raw = frame(spark, [raw_row(well=str(w), mon=str(m), oil=str(m)) for w in (1, 2) for m in range(1, 13)] + [raw_row(mon=" "), raw_row(year="")])
    RAW.store_raw_production(raw, str(tmp_path / "raw"))
    stored = RAW.read_raw_production(spark, str(tmp_path / "raw"), raw)
    rebuilt = TY.typed_production(stored, "2014-03-01", "2014-06-01")
    assert {(r.well_id, r.production_month.month) for r in rebuilt.collect()} == {(w, m) for w in ("1", "2") for m in (3, 4, 5)}
    plan = rebuilt._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "anio" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert TY.typed_production(raw, "2014-03-01", "2014-06-01").count() == rebuilt.count()


def test_a_scan_task_takes_a_small_share_of_a_file(spark, tmp_path):
    """What a task scans is typed and sorted in its memory, so large files are cut finer than by Spark's default."""
    path = str(tmp_path / "noise")
    spark.range(5_000_000).select(F.rand(1).alias("x")).coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(path)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # the number of cores must not cut the file
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")

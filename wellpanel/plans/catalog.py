"""Named queries over the bound tables: one per operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellpanel.functions import columns as C
from wellpanel.operators import backtest as B
from wellpanel.operators import champion as CH
from wellpanel.operators import decline as D
from wellpanel.operators import ensemble as EN
from wellpanel.operators import features as FT
from wellpanel.operators import incremental as IN
from wellpanel.operators import metrics as M
from wellpanel.operators import model as MD
from wellpanel.operators import quality as Q
from wellpanel.operators import reports as R
from wellpanel.operators import star as ST
from wellpanel.operators import supervised as SV
from wellpanel.operators import typed as TY
from wellpanel.operators.cutoffs import default_cutoff
from wellpanel.operators.ordering import exact_quantiles, global_rank
from wellpanel.plans import bindings as BD
from wellpanel.plans import monthly as MO
from wellpanel.plans import retraining as RT
from wellpanel.schema import FEATURE_CONTRACT, FLUID_LABELS, MEASURES, NUMERIC, PRODUCTION_SCHEMA, TEXT
from wellpanel.session import STORED, staging_path
from wellpanel.sources import published as PB
from wellpanel.sources import raw as RAW
from wellpanel.sources import tables as TB
from wellpanel.streaming import arrivals as AR
from wellpanel.streaming import service_metrics as SM

#: The evaluated cutoff and the 24 monthly cutoffs that end with it.
AS_OF = "2001-08-01"
CUTOFFS = [f"{1999 + (8 + k) // 12}-{(8 + k) % 12 + 1:02d}-01" for k in range(24)]
EVALUATED = CUTOFFS[-5:]
HORIZONS = (1, 2, 3)
LATENCY_BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
HOUR = 3600

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: text, bigint, and doubles at 6 decimals."""

    def shown(f: T.StructField):
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.IntegralType):
            c = c.cast("long")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[shown(f) for f in df.schema])


class Panel:
    """The layers of one query, built from the given tables on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return BD.table(self.spark, self.sf_dir, name)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write a layer that several consumers read, as the layered build does."""
        path = staging_path(self.spark, name)
        df.write.options(**STORED).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def raw(self) -> DataFrame:
        return BD.raw_production(self.table("lineitem"), self.table("supplier"))

    @cached_property
    def raw_registry(self) -> DataFrame:
        return BD.raw_registry(self.table("part"))

    @cached_property
    def silver(self) -> DataFrame:
        return TY.typed_production(self.raw)

    @cached_property
    def registry(self) -> DataFrame:
        return TY.typed_registry(self.raw_registry)

    @cached_property
    def silver_table(self) -> DataFrame:
        return self.stage(self.silver, "silver")

    @cached_property
    def fact(self) -> DataFrame:
        return ST.fact_production(self.silver_table)

    @cached_property
    def wells(self) -> DataFrame:
        return ST.dim_well(self.registry, self.silver_table)

    @cached_property
    def companies(self) -> DataFrame:
        return ST.dim_company(self.silver_table)

    @cached_property
    def dates(self) -> DataFrame:
        return ST.dim_date(self.silver_table)

    @cached_property
    def series(self) -> DataFrame:
        return self.silver_table.select("well_id", "production_month", "oil_prod_m3")

    @cached_property
    def features(self) -> DataFrame:
        return FT.well_features(self.fact, self.wells, CUTOFFS)

    @cached_property
    def feature_table(self) -> DataFrame:
        return self.stage(self.features, "features")

    @cached_property
    def dataset(self) -> DataFrame:
        # stored once: every request row is read again for its as-of answer
        return SV.training_dataset(self.feature_table, self.series, HORIZONS)

    @cached_property
    def dataset_table(self) -> DataFrame:
        return self.stage(self.dataset, "dataset")

    def predicted(self, cutoffs: list[str]) -> DataFrame:
        """Supervised rows of some cutoffs, with a moving average as the judged model."""
        features = self.stage(FT.well_features(self.fact, self.wells, cutoffs), "features")
        guess = F.coalesce("oil_prod_m3_roll_mean_12m", "naive_forecast_m3", F.lit(0.0))
        return SV.training_dataset(features, self.series, HORIZONS).withColumn("prediction_m3", guess)

    @cached_property
    def tested(self) -> DataFrame:
        """The supervised rows of every evaluated cutoff, with their predictions."""
        return self.stage(self.predicted(EVALUATED), "tested")

    @cached_property
    def log(self) -> DataFrame:
        return BD.request_log(self.table("events"))

    @cached_property
    def requests(self) -> DataFrame:
        """Serving requests derived from orders: a well, and a window or a cutoff."""
        o = self.table("orders")
        day = F.col("o_orderdate").cast("date")
        return o.select(
            F.col("o_custkey").cast("string").alias("well_id"),
            F.add_months(F.trunc(day, "MM"), -3).alias("date_start"),
            F.trunc(day, "MM").alias("date_end"),
            F.col("o_orderkey").alias("request_id"),
        )


def query(name: str):
    def register(build: Callable[[Panel], DataFrame]) -> Callable[[Panel], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: portable(build(Panel(spark, sf_dir)))
        return build

    return register


# --- sources, sinks, materialisation -------------------------------------------


def _csv_dump(p: Panel) -> str:
    """The raw snapshot as the publisher would hand it over: padded names, a nameless column."""
    path = staging_path(p.spark, "raw-csv")
    named = p.raw.select(
        *[F.col(c).alias(f" {c} " if c == "idpozo" else c) for c in p.raw.columns], F.lit("x").alias(" ")
    )
    named.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


@query("s01_raw_scan")
def _(p):
    return RAW.clean_header(RAW.read_raw_csv(p.spark, _csv_dump(p))).select(*p.raw.columns)


@query("s02_header_cleanup")
def _(p):
    cleaned = RAW.clean_header(RAW.read_raw_csv(p.spark, _csv_dump(p), multi_line=False))
    blank = cleaned.agg(*[F.count_if(F.col(c) == "").alias(c) for c in cleaned.columns])
    return blank.unpivot([], cleaned.columns, "column_name", "empty_cells")


@query("s03_tagged_load")
def _(p):
    tagged = RAW.tag_load(
        p.raw.drop("_dlt_load_id"), source="production_by_well",
        partition_key=RAW.operational_month("2001-11-01"), load_id="000000000042",
    )
    return tagged.groupBy(
        F.col("_source_name").alias("source_name"), F.col("_partition_key").alias("partition_key"),
        F.col("_dlt_load_id").alias("load_id"), "idempresa",
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query("s04_full_refresh")
def _(p):
    path = TB.layer_path(staging_path(p.spark, "lake"), "bronze", "wells_registry")
    TB.replace_table(p.raw_registry.filter("idpozo = ' '"), path)
    TB.replace_table(p.raw_registry, path)
    return TB.read_table(p.spark, path).select(*p.raw_registry.columns)


@query("s06_full_table")
def _(p):
    path = TB.layer_path(staging_path(p.spark, "lake"), "silver", "wells")
    TB.replace_table(p.registry, path)
    return TB.read_table(p.spark, path).select(*p.registry.columns)


@query("s07_replace_periods")
def _(p):
    path = TB.layer_path(staging_path(p.spark, "lake"), "silver", "production")
    PB.replace_periods(p.spark, p.silver, path)
    batch = p.silver.filter((F.col("production_month") >= "2001-01-01") & F.col("oil_prod_m3").isNotNull())
    PB.replace_periods(p.spark, batch, path)
    PB.expire(p.spark, path, keep=1)
    return PB.read_current(p.spark, path).select("well_id", "production_month", "oil_prod_m3")


@query("s08_upsert_by_key")
def _(p):
    path = TB.layer_path(staging_path(p.spark, "lake"), "gold", "fact_production")
    fact = p.fact.select("production_key", "well_id", "production_month", "oil_prod_m3")
    PB.replace_periods(p.spark, fact, path)
    recent = fact.filter((F.col("production_month") >= "2001-01-01") & F.col("oil_prod_m3").isNotNull())
    batch = recent.withColumn("oil_prod_m3", (F.col("oil_prod_m3") * 2).cast("decimal(18,6)"))
    PB.upsert_periods(p.spark, batch, path, ["production_key"])
    return PB.read_current(p.spark, path).select("production_key", "well_id", "production_month", "oil_prod_m3")


@query("s09_schema_drift")
def _(p):
    s = p.silver_table.select("well_id", "production_month", "province")
    old = s.filter("production_month < date'2000-01-01'").drop("province")
    return TB.append_with_drift(old, s.filter("production_month >= date'2000-01-01'"))


@query("s10_range_rebuild")
def _(p):
    path = staging_path(p.spark, "raw")
    RAW.store_raw_production(p.raw, path)
    return TY.typed_production(RAW.read_raw_production(p.spark, path, p.raw), "2000-01-01", "2000-07-01")


@query("s11_logical_view")
def _(p):
    ST.monthly_production_by_well(p.fact, p.wells, p.companies, p.dates).createOrReplaceTempView("v_monthly_production")
    return p.spark.sql(
        "SELECT basin, year, sum(oil_prod_m3) AS oil_prod_m3, count(*) AS n_rows FROM v_monthly_production GROUP BY basin, year"
    )


@query("s13_training_read")
def _(p):
    features, series = TB.training_frames(p.feature_table, p.fact, "2001-03-01")
    return features.groupBy("as_of_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("months_with_history").alias("months")
    ).withColumn("series_rows", series.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("s14_typed_extract")
def _(p):
    path = staging_path(p.spark, "extract")
    p.features.select(*FEATURE_CONTRACT).write.option("header", True).csv(path)
    return RAW.read_feature_extract(p.spark, path).groupBy("as_of_date", "basin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("oil_prod_m3_lag_1m").alias("lag_1m"),
        F.max("last_observed_month").alias("last_observed_month"),
    )


@query("s15_json_report")
def _(p):
    path = staging_path(p.spark, "report")
    TB.write_json_report(SV.dataset_footprint(p.dataset_table), path)
    back = p.spark.read.schema("rows long, wells long, cutoffs array<string>, horizons array<int>").json(path)
    return back.select(
        "rows", "wells", F.size("cutoffs").alias("n_cutoffs"), F.array_join("cutoffs", ",").alias("cutoffs"),
        F.array_join(F.col("horizons").cast("array<string>"), ",").alias("horizons"),
    )


# --- projections, filters, predicates ---------------------------------------------


@query("p01_type_production")
def _(p):
    return TY.type_production(p.raw)


@query("p02_type_registry")
def _(p):
    return TY.type_registry(p.raw_registry)


@query("p03_blank_to_null")
def _(p):
    names = {"empresa": "company_name", "sigla": "well_alias", "areayacimiento": "field"}
    return p.raw.groupBy(*[C.blank_to_null(old).alias(new) for old, new in names.items() if old != "sigla"]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(C.blank_to_null("sigla").isNull()).alias("blank_alias")
    )


@query("p04_non_negative")
def _(p):
    oil = C.non_negative("prod_pet")
    return p.raw.select(F.trim("prod_pet").alias("reported"), oil.alias("oil_prod_m3")).groupBy(
        "reported", "oil_prod_m3"
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query("p05_period_from_parts")
def _(p):
    return TY.type_production(p.raw).groupBy("production_month").agg(F.count(F.lit(1)).alias("n_rows"))


@query("p06_drop_blank_keys")
def _(p):
    kept = TY.type_production(p.raw).agg(F.count(F.lit(1)).alias("kept_declarations"))
    wells = TY.type_registry(p.raw_registry).agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.withColumn("kept_registry_rows", wells)


@query("p07_point_in_time")
def _(p):
    return p.silver.filter(F.col("production_month") < F.lit(AS_OF).cast("date")).select(
        "well_id", "production_month", "oil_prod_m3"
    )


@query("p08_half_open_range")
def _(p):
    return TB.month_range(p.silver, "2000-03-01", "2000-06-01").select("well_id", "production_month", *MEASURES)


@query("p09_production_window")
def _(p):
    return R.production_window(p.requests, p.fact).drop("date_start", "date_end")


@query("p10_optional_filters")
def _(p):
    return R.production_by_fluid(
        p.fact, p.wells, p.companies, p.dates, well_name="RED", month="2000-05-01", fluid=FLUID_LABELS["oil_prod_m3"]
    )


@query("p11_null_safe_inequality")
def _(p):
    a, b = p.registry.alias("a"), ST.latest_attributes(p.silver).alias("b")
    return a.join(b, "well_id").filter(C.differs(F.col("a.field"), F.col("b.field"))).select(
        "well_id", F.col("a.field").alias("registry_field"), F.col("b.field").alias("production_field")
    )


@query("p12_tolerance")
def _(p):
    f = FT.history_features(p.fact, AS_OF)
    return f.filter(
        C.differs_beyond(F.col("oil_prod_m3_roll_mean_6m"), F.col("oil_prod_m3_roll_mean_12m"), 1.0)
    ).select("well_id", "oil_prod_m3_roll_mean_6m", "oil_prod_m3_roll_mean_12m")


@query("p13_priority_merge")
def _(p):
    return p.wells.select("well_id", "well_alias", "field", "basin", "province")


@query("p14_contract_order")
def _(p):
    f = Q.require_feature_contract(FT.well_features(p.fact, p.wells, AS_OF).drop("feature_key"))
    return f.groupBy("basin", "field").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("zero_months_12m").alias("zero_months"))


@query("p15_lenient_coercion")
def _(p):
    number = C.lenient(F.trim("prod_gas"), NUMERIC)
    return p.raw.groupBy("idempresa").agg(
        F.count_if(number.isNull()).alias("unreadable"), F.sum(number.cast("decimal(18,2)")).alias("gas")
    )


@query("p16_strict_coercion")
def _(p):
    typed = p.silver_table.select(C.strict("well_id", TEXT).alias("well_id"), C.strict("oil_prod_m3", NUMERIC).alias("oil"))
    return typed.groupBy("well_id").agg(F.max("oil").alias("max_oil"), F.count("oil").alias("n_oil"))


@query("p17_model_input")
def _(p):
    rows = MD.model_input(p.dataset).drop("naive_forecast_m3")
    return rows.groupBy("as_of_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("x_oil_prod_m3_lag_1m").alias("lag_1m"),
        F.sum("na_oil_prod_m3_lag_12m").alias("missing_lag_12m"),
        F.sum("x_horizon").alias("horizons"),
    )


@query("p18_known_wells")
def _(p):
    return R.known_wells(p.requests, p.wells).select("request_id", "well_id")


@query("p19_feature_lookup")
def _(p):
    asked = p.requests.select("well_id", F.col("date_end").alias("as_of_date")).distinct()
    return R.feature_lookup(asked, p.feature_table).select("well_id", "as_of_date", "oil_prod_m3_lag_1m", "months_with_history")


# --- joins ----------------------------------------------------------------------------


@query("j01_fact_to_dimensions")
def _(p):
    view = ST.monthly_production_by_well(p.fact, p.wells, p.companies, p.dates)
    return view.select("well_id", "production_month", "company_name", "month_name", "oil_prod_m3")


@query("j02_universe_attributes")
def _(p):
    return p.wells.select("well_id", "depth_m", "latitude", "classification", "formation", "resource_type")


@query("j03_static_attributes")
def _(p):
    f = FT.history_features(p.fact, AS_OF).select("well_id", "as_of_date")
    return f.join(p.wells.select("well_id", "basin", "field", "resource_type"), "well_id", "left")


@query("j04_known_at_cutoffs")
def _(p):
    return FT.monthly_counts_at_cutoffs(p.fact, CUTOFFS)


@query("j05_full_outer_diff")
def _(p):
    a = p.silver_table.filter("basin = 'AUSTRAL'").groupBy("well_id").agg(F.count(F.lit(1)).alias("austral"))
    b = p.silver_table.filter("basin = 'NEUQUINA'").groupBy("well_id").agg(F.count(F.lit(1)).alias("neuquina"))
    return a.join(b, "well_id", "full_outer").filter(C.differs(F.col("austral"), F.col("neuquina")))


@query("j06_asof_backward")
def _(p):
    asked = p.requests.select("request_id", "well_id", F.col("date_end").alias("as_of_date"))
    return SV.asof_before(asked, p.series, "oil_prod_m3", "naive_forecast_m3")


@query("j06_asof_skip_nulls")
def _(p):
    asked = p.requests.select("request_id", "well_id", F.col("date_end").alias("as_of_date"))
    return SV.asof_before(asked, p.series, "oil_prod_m3", "last_value_m3", skip_nulls=True)


@query("j07_attach_target")
def _(p):
    keys = p.feature_table.select("well_id", "as_of_date")
    return keys.join(SV.targets_by_cutoff(p.series, HORIZONS), ["well_id", "as_of_date"])


@query("j08_unpivot_fluids")
def _(p):
    return R.unpivot_fluids(p.silver, ["well_id", "production_month"], FLUID_LABELS)


@query("j09_semi_eligible")
def _(p):
    keep = M.eligible_wells(p.series, EVALUATED)
    return p.dataset.join(keep, M.KEYS, "left_semi").select("well_id", "as_of_date", "horizon", "oil_prod_m3_target")


@query("j10_orphans")
def _(p):
    return Q.orphans(p.fact, "well_key", ST.dim_well(p.registry, p.silver_table).filter("depth_m is not null")).select(
        "well_id", "production_month"
    )


@query("j11_horizon_expansion")
def _(p):
    rows = SV.expand_horizons(p.features.select("well_id", "as_of_date"), range(1, 13))
    return rows.groupBy("target_month", "horizon").agg(F.count(F.lit(1)).alias("n_rows"))


@query("j12_failing_share")
def _(p):
    checks = [Q.accepted_range("oil_prod_m3", 0, 45), Q.not_null("well_alias")]
    failures = Q.failing_rows(p.silver_table, checks, "typed_production", ["well_id", "production_month"])
    return Q.failing_share(failures, p.silver_table)


@query("j13_align_denominators")
def _(p):
    test = p.predicted([AS_OF])
    joined = M.with_mase(M.score_wells(test), M.observed_history(p.series, [AS_OF]))
    return joined.select("well_id", "model_mae_m3", "insample_naive_mae_m3", "months_observed", "mase")


# --- aggregations ------------------------------------------------------------------------


@query("a01_lifetime_totals")
def _(p):
    return ST.lifetime_totals(p.silver, "well_id")


@query("a02_history_by_fluid")
def _(p):
    return R.history_by_fluid(p.fact, p.dates)


@query("a03_totals_by_alias")
def _(p):
    return R.totals_by_alias(p.fact, p.wells)


@query("a04_lags")
def _(p):
    return FT.history_features(p.silver_table, CUTOFFS).select("well_id", "as_of_date", *[f"oil_prod_m3_lag_{k}m" for k in (1, 2, 3, 6, 12)])


@query("a05_rolling_means")
def _(p):
    return FT.history_features(p.silver_table, CUTOFFS).select("well_id", "as_of_date", *[f"oil_prod_m3_roll_mean_{k}m" for k in (3, 6, 12)])


@query("a06_rolling_stddev")
def _(p):
    return FT.history_features(p.silver_table, CUTOFFS).select("well_id", "as_of_date", *[f"oil_prod_m3_roll_std_{k}m" for k in (6, 12)])


@query("a07_trend")
def _(p):
    return FT.history_features(p.silver_table, CUTOFFS).select("well_id", "as_of_date", *[f"oil_prod_m3_trend_{k}m" for k in (6, 12)])


@query("a08_zero_months")
def _(p):
    return FT.history_features(p.silver_table, CUTOFFS).select("well_id", "as_of_date", "zero_months_12m")


@query("a09_history_span")
def _(p):
    return FT.history_features(p.silver_table, CUTOFFS).select(
        "well_id", "as_of_date", "months_with_history", "well_age_months", "months_since_last_observed", "last_observed_month"
    )


@query("a10_default_cutoff")
def _(p):
    return default_cutoff(p.silver)


@query("a11_distinct_months")
def _(p):
    return p.silver.select("production_month").distinct()


@query("a12_eligible_wells")
def _(p):
    return M.eligible_wells(p.silver, EVALUATED)


@query("a13_one_step_naive_mae")
def _(p):
    return M.one_step_naive_mae(p.silver, EVALUATED)


@query("a14_per_well_metrics")
def _(p):
    test = p.predicted(EVALUATED)
    return M.per_well_metrics(test, M.observed_history(p.series, EVALUATED))


@query("a15_pooled_metrics")
def _(p):
    return M.pooled_metrics(SV.temporal_split(p.stage(p.predicted(CUTOFFS), "predicted"), AS_OF, validation_cutoffs=3))


@query("a16_quantiles")
def _(p):
    totals = p.silver.filter(F.col("oil_prod_m3").isNotNull()).select(
        "basin", F.col("oil_prod_m3").cast("double").alias("oil"), F.concat_ws("/", "well_id", "production_month").alias("row_id")
    )
    return exact_quantiles(totals, ["basin"], "oil", "row_id", M.QUANTILES)


@query("a17_portfolio")
def _(p):
    wells = B.well_table(p.predicted(EVALUATED), p.series, EVALUATED, decline=False)
    wells = p.stage(wells, "wells")
    return B.summarise(wells, B.metric_quantiles(wells)).select("as_of_date", "mase_median", "naive_mae_ratio", "model_mae_m3", "naive_mae_m3")


@query("a18_coverage")
def _(p):
    wells = B.well_table(p.predicted(EVALUATED), p.series, EVALUATED, decline=False)
    return B.coverage(wells).select(
        "as_of_date", "wells_in_test", "wells_eligible", "wells_excluded_short_history", "wells_mase_undefined"
    )


@query("a19_materialisation_metadata")
def _(p):
    return FT.materialisation_metadata(p.features, p.fact, CUTOFFS)


@query("a20_dataset_footprint")
def _(p):
    foot = SV.dataset_footprint(p.dataset_table)
    return foot.select(
        "rows", "wells", F.array_join(F.col("cutoffs").cast("array<string>"), ",").alias("cutoffs"),
        F.array_join(F.col("horizons").cast("array<string>"), ",").alias("horizons"),
    )


@query("a21_control_totals")
def _(p):
    return R.control_totals(p.silver, "2000-01-01", "2000-04-01")


@query("a22_duplicates")
def _(p):
    return Q.duplicates(TY.type_production(p.raw), "well_id", "production_month")


@query("a23_profile")
def _(p):
    return Q.profile(p.silver_table)


@query("a23_profile_documents")
def _(p):
    return Q.profile(p.table("documents"))


# --- windows -------------------------------------------------------------------------------


@query("w01_latest_load")
def _(p):
    return p.silver.select("well_id", "production_month", "dlt_load_id", "company_id", *MEASURES)


@query("w02_first_name")
def _(p):
    return ST.dim_company(p.silver).select("company_id", "company_name")


@query("w03_latest_attributes")
def _(p):
    return ST.latest_attributes(p.silver)


@query("w04_global_rank")
def _(p):
    totals = ST.lifetime_totals(p.silver, "well_id").select("well_id", "total_oil_m3")
    return global_rank(totals, [F.desc_nulls_last("total_oil_m3"), F.asc("well_id")], "oil_volume_rank")


@query("w05_step_differences")
def _(p):
    return M.step_differences(p.silver)


@query("w06_recent_peak")
def _(p):
    return FT.rolling_peak(p.silver)


@query("w07_validation_cutoffs")
def _(p):
    return SV.split_cutoffs(p.features, AS_OF, 3)


# --- order, limits, sets --------------------------------------------------------------------


@query("t01_production_order")
def _(p):
    return R.production_order(
        R.production_by_fluid(p.fact, p.wells, p.companies, p.dates, fluid=FLUID_LABELS["gas_prod_mm3"])
    )


@query("t02_top_by_fluid")
def _(p):
    return R.top_by_fluid(p.fact, p.wells)


@query("t03_evidence_sample")
def _(p):
    failures = Q.failing_rows(
        p.silver_table, [Q.accepted_range("oil_prod_m3", 0, 45)], "typed_production", ["well_id", "production_month"]
    )
    return Q.evidence_sample(failures, "2000-05-01").select("well_id", "production_month", "check_name")


@query("t04_dataset_order")
def _(p):
    return SV.dataset_order(p.dataset.select("as_of_date", "well_id", "horizon", "oil_prod_m3_target"))


@query("u01_well_universe")
def _(p):
    return ST.well_universe(p.registry, p.silver)


@query("u02_union_of_horizons")
def _(p):
    frames = [SV.expand_horizons(p.feature_table.select("well_id", "as_of_date"), [h]) for h in HORIZONS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


# --- scalar functions ------------------------------------------------------------------------


@query("x01_text_functions")
def _(p):
    return p.raw_registry.select(
        C.blank_to_null("idpozo").alias("well_id"),
        F.coalesce(C.blank_to_null("cuenca"), C.blank_to_null("provincia"), F.lit("-")).alias("place"),
        F.when(F.trim("profundidad") == "", 0.0).otherwise(C.blank_to_null("profundidad").cast("double")).alias("depth"),
    )


@query("x02_surrogate_key")
def _(p):
    return p.silver.select("well_id", "production_month", C.surrogate_key("well_id", "production_month").alias("production_key"),
                           C.surrogate_key("well_alias").alias("alias_key"))


def _days(p: Panel) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return p.table("orders").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("x03_month_arithmetic")
def _(p):
    m = C.month_start("day")
    return _days(p).select("day", "n_orders", m.alias("month"), F.add_months(m, -1).alias("month_before"), F.add_months(m, 12).alias("year_after"))


@query("x04_date_parts")
def _(p):
    return _days(p).select("day", F.year("day").alias("y"), F.month("day").alias("m"), F.quarter("day").alias("q"))


@query("x05_month_name")
def _(p):
    return ST.dim_date(p.silver).select("production_month", "month_name")


@query("x06_whole_months")
def _(p):
    return p.silver.groupBy("well_id").agg(F.min("production_month").alias("a"), F.max("production_month").alias("b")).select(
        "well_id", C.months_between_int("b", "a").alias("months")
    )


@query("x07_month_index")
def _(p):
    return _days(p).select("day", C.month_index("day").cast("double").alias("month_index"))


@query("x08_month_offset")
def _(p):
    return _days(p).select("day", *[C.shift_months("day", k).alias(f"plus_{k}") for k in (1, 5, 12)])


@query("x09_numeric_functions")
def _(p):
    q = F.col("oil_prod_m3").cast("double")
    return p.silver.groupBy("well_id").agg(
        F.sqrt(F.avg(F.power(q - 10, 2))).alias("rms"), F.max(F.abs(q - 10)).alias("widest"), F.round(F.avg(q), 2).alias("mean_2")
    )


@query("x10_ilike")
def _(p):
    return p.registry.filter(C.contains_text("well_alias", "RED")).select("well_id", "well_alias")


@query("x11_definition_hash")
def _(p):
    version = F.sha2(F.concat_ws("|", F.col("as_of_date").cast("string"), F.lit("features-1")), 256)
    return p.features.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("feature_version", version)


# --- quality ------------------------------------------------------------------------------------


def _first_month():
    import datetime as dt

    return dt.date(1995, 1, 1)


def _silver_checks() -> list[Q.Check]:
    return Q.typed_production_checks("2001-12-15", first_month=_first_month())


@query("q01_schema_contract")
def _(p):
    return Q.require_schema(p.silver, PRODUCTION_SCHEMA)


@query("q02_not_null")
def _(p):
    return p.silver_table.filter(Q.not_null("well_alias").fails).select("well_id", "production_month")


@query("q03_unique")
def _(p):
    return Q.duplicates(TY.type_registry(p.raw_registry), "well_id")


@query("q04_unique_combination")
def _(p):
    return Q.duplicates(p.table("lineitem"), "l_orderkey", "l_linenumber")


@query("q05_accepted_range")
def _(p):
    return p.silver.filter(Q.accepted_range("oil_prod_m3", 2, 45).fails).select("well_id", "production_month", "oil_prod_m3")


@query("q06_not_null_share")
def _(p):
    checks = [Q.not_null_share(c, 0.95) for c in (*MEASURES, "well_alias", "field")]
    return Q.run_checks(p.silver, checks, "typed_production")


@query("q07_recency")
def _(p):
    return Q.run_checks(p.silver, [Q.recency("production_month", "2001-12-15"), Q.recency("production_month", "2002-06-15")], "typed_production")


@query("q08_relationships")
def _(p):
    docs = p.table("documents")
    return Q.run_checks(
        p.table("labels"), [Q.references("doc_id", docs), Q.references("doc_id", docs.filter("lang = 'en'"))], "labels"
    )


@query("q09_point_in_time_audit")
def _(p):
    leaked = FT.well_features(p.fact, p.wells, EVALUATED)
    stored = leaked.withColumn(
        "oil_prod_m3_lag_1m",
        F.when(F.col("basin") == "AUSTRAL", F.col("oil_prod_m3_lag_1m") + 1).otherwise(F.col("oil_prod_m3_lag_1m")),
    ).filter("months_since_last_observed < 12")
    found = FT.audit_features(p.stage(stored, "stored"), p.fact)
    return found.select("well_id", "as_of_date", "missing_in_store", "missing_in_fact")


@query("q10_feature_contract")
def _(p):
    ok = Q.require_feature_contract(p.feature_table.drop("feature_key"))
    return ok.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query("q11_failing_rows")
def _(p):
    checks = [Q.accepted_range("oil_prod_m3", 0, 45), Q.not_null("field"), Q.unique("well_id", "production_month")]
    return Q.failing_rows(p.silver_table, checks, "typed_production", ["well_id", "production_month"]).drop("row_json")


@query("q12_blocking_gate")
def _(p):
    results = Q.run_checks(p.silver_table, _silver_checks(), "typed_production")
    Q.require_passed(results)
    return ST.fact_production(p.silver_table).groupBy("production_month").agg(F.count(F.lit(1)).alias("n_rows"))


@query("q13_failed_checks")
def _(p):
    checks = [*_silver_checks(), Q.recency("production_month", "2003-01-01"), Q.accepted_range("oil_prod_m3", 0, 45),
              Q.not_null("well_alias"), Q.unique("well_id")]
    return Q.failed_checks(Q.run_checks(p.silver_table, checks, "typed_production"))


@query("q14_fitness")
def _(p):
    checks = [Q.accepted_range("oil_prod_m3", 0, 49), Q.unique("well_id", "production_month")]
    return _fitness(p, checks)


@query("q14_fitness_unfit")
def _(p):
    return _fitness(p, [Q.accepted_range("oil_prod_m3", 0, 49), Q.not_null("company_name"), Q.unique("well_id", "resource_type", "formation", "company_id")])


def _fitness(p: Panel, checks: list[Q.Check]) -> DataFrame:
    failures = Q.failing_rows(p.silver_table, checks, "typed_production", ["well_id", "production_month"])
    return Q.fitness(failures, p.silver_table)


@query("q_text_tables")
def _(p):
    docs = p.table("documents")
    checks = [Q.not_null("doc_id"), Q.not_null("text"), Q.unique("doc_id"), Q.accepted_range("n_chars", 1), Q.not_null_share("lang")]
    talk = [Q.not_null("text"), Q.unique("conv_id", "turn"), Q.accepted_range("turn", 0)]
    return Q.run_checks(docs, checks, "documents").unionByName(Q.run_checks(p.table("conversations"), talk, "conversations"))


# --- composite jobs --------------------------------------------------------------------------------


@query("f01_typed_production")
def _(p):
    return p.silver


@query("f02_typed_registry")
def _(p):
    return p.registry


@query("f03_dim_well")
def _(p):
    return ST.dim_well(p.registry, p.silver)


@query("f04_dim_company")
def _(p):
    return ST.dim_company(p.silver)


@query("f05_dim_date")
def _(p):
    return ST.dim_date(p.silver)


@query("f06_fact_production")
def _(p):
    return ST.fact_production(p.silver)


@query("f07_monthly_production")
def _(p):
    return ST.monthly_production_by_well(p.fact, p.wells, p.companies, p.dates)


@query("f08_top_wells")
def _(p):
    return ST.top_wells_by_volume(p.fact, p.wells)


@query("f09_production_by_fluid")
def _(p):
    return R.production_by_fluid(p.fact, p.wells, p.companies, p.dates)


@query("f09_history_since")
def _(p):
    return R.history_by_fluid(p.fact, p.dates, since="2000-01-01", fluid=FLUID_LABELS["water_prod_m3"])


@query("f09_top_named")
def _(p):
    return R.top_by_fluid(p.fact, p.wells, well_name="ring")


@query("f10_well_features")
def _(p):
    return p.features


@query("f10_single_cutoff")
def _(p):
    return FT.well_features(p.fact, p.wells)


@query("f10_incremental_features")
def _(p):
    """Features of an older state of the fact, brought up to date from the months and wells that changed since.

    In the older state one month had not arrived, every seventh well declared other volumes in a later one, every
    eleventh a month that it withdrew, one well was a stray, and some wells lay elsewhere.
    """
    fact, wells = p.stage(p.fact.select("well_id", "production_month", "oil_prod_m3"), "fact"), p.stage(p.wells, "wells")
    number = F.col("well_id").cast("long")
    late, revised = F.to_date(F.lit("2000-03-01")), F.to_date(F.lit("2000-09-01"))
    other = F.when((number % 7 == 0) & (F.col("production_month") == revised), F.col("oil_prod_m3") + 1).otherwise(F.col("oil_prod_m3"))
    kept = fact.filter(F.col("production_month") != late).withColumn("oil_prod_m3", other.cast(fact.schema["oil_prod_m3"].dataType))
    first = fact.groupBy("well_id").agg(F.min("production_month").alias("m"))
    withdrawn = first.filter(number % 11 == 0).select("well_id", F.add_months("m", -2).alias("production_month"))
    stray = first.agg(F.concat(F.lit("stray-"), F.min("well_id")).alias("well_id"), F.min("m").alias("production_month"))
    old = p.stage(kept.unionByName(withdrawn.unionByName(stray), allowMissingColumns=True), "older")
    elsewhere = wells.withColumn("field", F.when(number % 5 == 0, F.lit("elsewhere")).otherwise(F.col("field")))
    stored = p.stage(FT.well_features(old, elsewhere, CUTOFFS), "features")
    change = IN.refreshed_features(stored, fact, wells, IN.changed_months(old, fact), IN.changed_wells(elsewhere, wells), CUTOFFS)
    return IN.with_change(stored, change)


@query("f11_training_dataset")
def _(p):
    return p.dataset.select("well_id", "as_of_date", "horizon", "target_month", "oil_prod_m3_target", "naive_forecast_m3", "oil_prod_m3_lag_1m", "basin")


@query("f12_temporal_split")
def _(p):
    return SV.temporal_split(p.dataset_table, AS_OF, validation_cutoffs=3).select("well_id", "as_of_date", "horizon", "split")


@query("f12_purged_split")
def _(p):
    split = SV.temporal_split(p.dataset_table, AS_OF, validation_cutoffs=3, purge_overlap=True)
    return split.groupBy("split", "as_of_date").agg(F.count(F.lit(1)).alias("n_rows"), F.max("target_month").alias("last_target"))


#: The fitted regression of each set of tables: fitted once a session, read by every query that serves it.
_FITTED: dict[tuple[str, str], tuple[MD.Fitted, DataFrame]] = {}


def _fitted(p: Panel) -> tuple[MD.Fitted, DataFrame]:
    """The published model, and the split it was fitted on."""
    key = (p.spark.sparkContext.applicationId, p.sf_dir)
    if key not in _FITTED:
        rows = p.stage(SV.temporal_split(p.dataset_table, AS_OF), "split")
        _FITTED[key] = MD.fit(rows.filter("split = 'train'")), rows
    return _FITTED[key]


@query("f13_global_regression")
def _(p):
    fitted, rows = _fitted(p)
    return MD.predict(fitted, rows.filter("split = 'test'")).select("well_id", "as_of_date", "horizon", "prediction_m3")


@query("f13_scored_rows")
def _(p):
    """What can be compared of a fitted model: every tested row has one finite prediction."""
    fitted, rows = _fitted(p)
    scored = MD.predict(fitted, rows.filter("split = 'test'"))
    finite = F.col("prediction_m3").isNotNull() & ~F.isnan("prediction_m3")
    return scored.groupBy("as_of_date", "horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(finite).alias("n_scored"))


def _agreement(scored: DataFrame, fitted: MD.Fitted, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a horizon, and those whose prediction joins with the stored trees repeat."""
    again = EN.score_by_nodes(EN.model_vectors(fitted, inputs, keys), EN.node_table(fitted), keys, MD.TREES, MD.TREE_DEPTH)
    near = F.abs(F.col("prediction_m3") - F.col("repeated")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("repeated"))
    beside = scored.join(again.withColumnRenamed("prediction_m3", "repeated"), keys, "left")
    return beside.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(near).alias("n_agreeing"))


@query("f13_scored_by_nodes")
def _(p):
    """Predictions of the tested rows against a walk through the stored trees."""
    fitted, rows = _fitted(p)
    tested = rows.filter("split = 'test'")
    keys = ["well_id", "as_of_date", "horizon"]
    return _agreement(MD.predict(fitted, tested).select(*keys, "prediction_m3"), fitted, tested, keys)


@query("f14_forecast_by_nodes")
def _(p):
    """Every batch forecast against a walk through the stored trees."""
    fitted, keys = _fitted(p)[0], ["well_id", "as_of_date", "horizon"]
    # a forecast is dated by its last observed month, its features a month later
    made = p.stage(_forecast(p).filter("status = 'ok'").select("well_id", F.add_months("as_of_date", 1).alias("as_of_date"), "horizon", F.col("oil_prod_m3").alias("prediction_m3")), "forecast")
    inputs = SV.expand_horizons(p.feature_table.join(made.select("well_id", "as_of_date").distinct(), ["well_id", "as_of_date"], "left_semi"), range(1, 7))
    return _agreement(made, fitted, inputs, keys)


def _forecast(p: Panel) -> DataFrame:
    asked = p.requests.select("well_id", F.add_months("date_end", 0).alias("as_of_date"))
    return MD.forecast(_fitted(p)[0], p.feature_table, asked, 6)


@query("f14_batch_forecast")
def _(p):
    return _forecast(p)


@query("f14_forecast_frame")
def _(p):
    """Every request answered: its months and flags, or that its features are missing."""
    return _forecast(p).select("well_id", "as_of_date", "horizon", "month", "extrapolated", "status")


@query("f15_persistence")
def _(p):
    keys = p.feature_table.select("well_id", "as_of_date")
    return SV.asof_before(keys, p.series, "oil_prod_m3", "naive_forecast_m3")


@query("f16_decline_fit")
def _(p):
    """Every fit beside the minimum of its squared error over the whole grid, which SQL can compute."""
    fits, grid = p.stage(D.fit_declines(p.series, EVALUATED), "fits"), p.stage(D.grid_fits(p.series, EVALUATED), "grid")
    return D.certified(fits, grid).select("as_of_date", "well_id", "t0_month", "positive_months", F.round("grid_sse", 2).alias("grid_sse"), "certified")


@query("f16_decline_inputs")
def _(p):
    return D.decline_inputs(p.series, EVALUATED).select(
        "as_of_date", "well_id", "t0_month", "positive_months",
        F.aggregate("t", F.lit(0.0), lambda a, x: a + x).alias("t_sum"),
        F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("q_sum"),
    )


@query("f17_decline_mape")
def _(p):
    """Where the fitted curve has an error, and that of the best grid cell, which SQL can compute."""
    fits, grid = p.stage(D.fit_declines(p.series, EVALUATED), "fits"), p.stage(D.grid_fits(p.series, EVALUATED), "grid")
    of_grid = D.decline_mape(p.tested, grid).withColumnRenamed("arps_mape_nonzero_pct", "grid_mape_nonzero_pct")
    return D.decline_mape(p.tested, fits).join(of_grid, ["as_of_date", "well_id"], "full").select(
        "as_of_date", "well_id", F.col("arps_mape_nonzero_pct").isNotNull().alias("arps_defined"), "grid_mape_nonzero_pct",
    )


#: How far a number that rests on fitted declines may lie from the one that rests on the best grid cells: percentage
#: points, and a share of the latter.  Everything else must be equal.
FIT_TOLERANCE_PP, FIT_TOLERANCE_SHARE = 1.0, 0.02


def _backtest(p: Panel) -> B.Backtest:
    return B.evaluate(p.tested, p.series, EVALUATED)


def _reference(p: Panel) -> B.Backtest:
    """The same backtest with the best grid cell as the decline baseline."""
    return B.evaluate(p.tested, p.series, EVALUATED, fit=D.grid_fits)


def _beside(found: DataFrame, reference: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``found`` with the reference's ``values`` and whether its own lie within the tolerance of them."""
    other = reference.select(*keys, *[F.col(v).alias(f"{v}_ref") for v in values])
    near = F.lit(True)
    for v in values:
        ref = F.col(f"{v}_ref")
        close = F.abs(F.col(v) - ref) <= FIT_TOLERANCE_PP + FIT_TOLERANCE_SHARE * F.abs(ref)
        near = near & F.coalesce(close, F.col(v).isNull() & ref.isNull())
    return found.join(other, keys, "full").select(
        *[c for c in found.columns if c not in values], *[F.col(f"{v}_ref").alias(v) for v in values], near.alias("within_tolerance")
    )


@query("f18_backtest")
def _(p):
    return _backtest(p).summary.select(
        "as_of_date", "wells_in_test", "wells_eligible", "wells_excluded_short_history", "wells_mase_undefined",
        "model_mae_m3", "naive_mae_m3", "arps_fitted_wells", "arps_failed_wells", "arps_degraded", "mase_median", "naive_mae_ratio",
    )


@query("f18_backtest_distributions")
def _(p):
    return _beside(_backtest(p).distributions, _reference(p).distributions, ["as_of_date", "metric"], ["p50", "p75", "p90"])


@query("f18_backtest_with_decline")
def _(p):
    columns = ["as_of_date", "arps_fitted_wells", "arps_failed_wells", "arps_degraded", "arps_mape_gap_pp"]
    return _beside(_backtest(p).summary.select(*columns), _reference(p).summary, ["as_of_date"], ["arps_mape_gap_pp"])


@query("s15_evaluation_report")
def _(p):
    path = staging_path(p.spark, "evaluation")
    TB.write_json_report(B.report_rows(_backtest(p), horizons=HORIZONS), path)
    stored = (
        "as_of_date date, wells_in_test long, arps_fitted_wells long, arps_degraded boolean, mase_median double, gates_passed boolean, "
        "gates array<struct<gate:string,passed:boolean>>, horizons array<int>, distributions map<string,struct<p50:double>>"
    )
    return p.spark.read.schema(stored).json(path).select(
        "as_of_date", "wells_in_test", "arps_fitted_wells", "arps_degraded", "mase_median", "gates_passed", F.size("gates").alias("n_gates"),
        F.size(F.filter("gates", lambda g: g["passed"])).alias("n_passed"), F.size("distributions").alias("n_distributions"),
        F.array_join(F.col("horizons").cast("array<string>"), ",").alias("horizons"),
    )


@query("f19_gates")
def _(p):
    return _beside(_backtest(p).gates, _reference(p).gates, ["as_of_date", "gate"], ["value"])


@query("f20_long_metrics")
def _(p):
    return _beside(_backtest(p).metrics, _reference(p).metrics, ["as_of_date", "metric"], ["value"])


@query("f21_multi_cutoff")
def _(p):
    result = _backtest(p)
    shown = ["as_of_date", "mase_median", "naive_mae_ratio", "arps_mape_gap_pp"]
    return _beside(result.summary.select(*shown), _reference(p).summary, ["as_of_date"], ["arps_mape_gap_pp"]).join(B.gates_passed(result.gates), "as_of_date")


@query("f22_champion")
def _(p):
    result = _backtest(p)
    verdict = result.summary.join(B.gates_passed(result.gates), "as_of_date")
    label = F.date_format("as_of_date", "yyyyMM")
    versions = verdict.select(
        F.lit("oil").alias("model"), label.alias("version"), F.concat(F.lit("run-"), label).alias("run_id"), "as_of_date",
        F.create_map(F.lit("mase_median"), F.col("mase_median"), F.lit("arps_mape_gap_pp"), F.col("arps_mape_gap_pp")).alias("metrics"), "gates_passed",
        F.col("as_of_date").alias("registered_at"),
    )
    promotions = verdict.select(F.lit("oil").alias("model"), label.alias("version"), F.col("as_of_date").alias("requested_at"))
    return CH.with_decision(CH.registered_versions(versions)).select("version", "gates_passed", "decision").join(
        CH.current_champion(versions, promotions).select("version", F.lit(True).alias("champion")), "version", "left"
    ).withColumn("champion", F.coalesce("champion", F.lit(False)))


@query("f23_serving_reads")
def _(p):
    asked = R.known_wells(p.requests, p.wells)
    return R.production_window(asked, p.fact).groupBy("request_id", "well_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("prod").cast("decimal(18,6)")).alias("total"), F.min("date").alias("first_date")
    )


@query("f23_well_list")
def _(p):
    return R.well_list(p.wells)


@query("b01_monthly_build")
def _(p):
    """The layered build twice: everything, then a rerun of the newest months and cutoffs."""
    lake = MO.Lake(staging_path(p.spark, "lake"))
    common = {"raw": p.raw, "raw_registry": p.raw_registry, "lake": lake, "checks": _silver_checks()}
    MO.run_month(p.spark, version=0, run="first", cutoffs=EVALUATED[:3], **common)
    MO.run_month(p.spark, version=1, run="second", cutoffs=EVALUATED[2:], start="2001-07-01", end="2001-12-01", **common)
    stored = PB.read_current(p.spark, lake.path("features", "well_features"), "as_of_date")
    return stored.select("feature_key", *FEATURE_CONTRACT)


@query("b01_quality_results")
def _(p):
    """Every gate of one build, and two on damaged copies: wells without a depth removed, one feature moved."""
    lake = MO.Lake(staging_path(p.spark, "lake"))
    found = MO.run_month(
        p.spark, p.raw, p.raw_registry, lake, checks=_silver_checks(), version=0, run="first", cutoffs=EVALUATED[:2],
    )
    fact = PB.read_current(p.spark, lake.path("gold", "fact_production"))
    features = PB.read_current(p.spark, lake.path("features", "well_features"), "as_of_date")
    wells = TB.read_version(p.spark, lake.path("gold", "dim_well"), 0).filter("depth_m is not null")
    orphaned = Q.run_checks(fact, [Q.references("well_key", wells)], "fact_production damaged")
    moved = features.withColumn("months_with_history", F.col("months_with_history") + (F.col("months_with_history") == 12).cast("int"))
    wrong = FT.audit_features(moved, fact)
    leaked = Q.run_checks(moved, [Q.absent_from("point_in_time", ["well_id", "as_of_date"], wrong)], "well_features damaged")
    return found.unionByName(orphaned).unionByName(leaked).select("table_name", "check_name", "failing_rows", "total_rows", "passed")


@query("b02_retraining")
def _(p):
    out = RT.retrain(p.feature_table.drop("feature_key"), p.fact, AS_OF, validation_cutoffs=3, purge_overlap=True)
    return out.backtest.metrics


# --- request log --------------------------------------------------------------------------------------


@query("r02_request_rate")
def _(p):
    return SM.request_rate(p.log)


@query("r03_latency_percentiles")
def _(p):
    return SM.latency_percentiles(p.log, HOUR)


@query("r03_latency_histogram")
def _(p):
    return SM.latency_histogram(p.log, LATENCY_BOUNDS, HOUR)


@query("r04_error_share")
def _(p):
    return SM.error_share(p.log)


@query("r05_trailing_by_status")
def _(p):
    return SM.trailing_requests(p.log, True)


@query("r05_trailing_total")
def _(p):
    return SM.trailing_requests(p.log, False)


@query("r06_mean_latency")
def _(p):
    return SM.mean_latency(p.log)


@query("r07_sustained_alert")
def _(p):
    return SM.sustained_alert(SM.handler_latency(p.log, HOUR), "mean_latency", ["handler"], threshold=30.0, held=5, step_seconds=HOUR)


def _stream(p: Panel, name: str) -> DataFrame:
    schema = p.table(name).schema
    return p.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(p.sf_dir)


def _streamed(p: Panel, metric: Callable[[DataFrame], DataFrame], name: str, *keys: str) -> DataFrame:
    out = staging_path(p.spark, name)
    live = metric(SM.watermarked(BD.request_log(_stream(p, "events"))))
    SM.run_to_table(live, list(keys), out, staging_path(p.spark, f"{name}-progress"))
    return p.spark.read.parquet(out).select(*live.columns)


@query("r01_arrivals")
def _(p):
    """Line items arrive in three deliveries that touch the same months."""
    inbox, progress = staging_path(p.spark, "inbox"), staging_path(p.spark, "arrivals")
    lineitem = p.table("lineitem")
    path = TB.layer_path(staging_path(p.spark, "lake"), "silver", "production")
    for turn in range(3):
        lineitem.filter(F.col("l_linenumber") % 3 == turn).write.mode("append").parquet(inbox)
        # drained before the next one arrives: a delivery is one batch, however many files it was written in
        deliveries = p.spark.readStream.schema(lineitem.schema).parquet(inbox)
        AR.run_arrivals(BD.raw_production(deliveries, p.table("supplier")), path, progress, _silver_checks)
    return TB.read_table(p.spark, path).select(*PRODUCTION_SCHEMA.fieldNames())


@query("r02_request_rate_stream")
def _(p):
    return _streamed(p, SM.request_rate, "rate", "handler")


@query("r03_latency_histogram_stream")
def _(p):
    return _streamed(p, lambda log: SM.latency_histogram(log, LATENCY_BOUNDS, HOUR), "latency", "handler")


@query("r03_latency_percentiles_stream")
def _(p):
    return _streamed(p, lambda log: SM.streamed_percentiles(log, HOUR), "percentiles", "handler")


@query("r04_error_share_stream")
def _(p):
    return _streamed(p, SM.error_share, "errors")


@query("r05_trailing_by_status_stream")
def _(p):
    return _streamed(p, lambda log: SM.trailing_requests(log, True), "trailing", "status")


@query("r05_trailing_total_stream")
def _(p):
    return _streamed(p, lambda log: SM.trailing_requests(log, False), "trailing-total")


@query("r06_mean_latency_stream")
def _(p):
    return _streamed(p, SM.mean_latency, "mean")


@query("r07_sustained_alert_stream")
def _(p):
    """Events arrive in three stretches of time; every stretch decides the alerts that it can change."""
    inbox, path, progress = (staging_path(p.spark, n) for n in ("events", "alerts", "alerts-progress"))
    events = p.table("events")
    ends = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    cuts = [ends.first + (ends.last - ends.first) * k / 3 for k in (1, 2)]
    turn = sum((F.col("ts") >= F.lit(c)).cast("int") for c in cuts)
    for k in range(3):
        events.filter(turn == k).write.mode("append").parquet(inbox)
        log = BD.request_log(p.spark.readStream.schema(events.schema).parquet(inbox))
        live = SM.handler_latency(SM.watermarked(log), HOUR)
        SM.run_alert(live, "mean_latency", ["handler"], path, progress, threshold=30.0, held=5, step_seconds=HOUR)
    return SM.current_alerts(p.spark, path, ["handler"])

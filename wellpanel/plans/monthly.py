"""The monthly build: raw snapshots -> typed tables -> checks -> star schema -> features."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.operators import features as FT
from wellpanel.operators import incremental as IN
from wellpanel.operators import quality as Q
from wellpanel.operators import star as ST
from wellpanel.operators import typed as TY
from wellpanel.operators.cutoffs import Cutoffs, cutoff_array
from wellpanel.schema import PRODUCTION_SCHEMA
from wellpanel.session import durable, job_scratch
from wellpanel.sources import published as PB
from wellpanel.sources import tables as TB

Day = dt.date | str


#: Tables that change by period, each at one moment.
PUBLISHED = (("silver", "production"), ("gold", "fact_production"), ("features", "well_features"))


@dataclass(frozen=True)
class Lake:
    """Where the tables of one deployment live."""

    root: str

    def path(self, layer: str, table: str) -> str:
        return TB.layer_path(self.root, layer, table)


def _gate(lake: Lake, run: str, table: str, rows: DataFrame, checks: list[Q.Check], keys: list[str]) -> DataFrame:
    """Check one table, keep results and evidence under the run's name, and stop the chain if a blocking check failed.

    Evidence is looked for where a check found something: for keys that repeat, or lack a parent, it shuffles whole rows.
    """
    path = f"{lake.path('silver', 'quality_results')}/run={run}/checked={table}"
    TB.replace_table(Q.run_checks(rows, checks, table), path)
    results = rows.sparkSession.read.parquet(path)
    # one name a check
    found = {r.check_name for r in results.filter("failing_rows > 0").select("check_name").collect()}
    evidence = Q.failing_rows(rows, [c for c in checks if c.name in found], table, keys)
    TB.replace_table(evidence, f"{lake.path('silver', 'quality_failures')}/run={run}/checked={table}")
    Q.require_passed(results)
    return results


def build_typed(spark: SparkSession, raw: DataFrame, raw_registry: DataFrame, lake: Lake, checks: list[Q.Check], run: str, *,
                start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Stage the months of the range (or all of them) and the whole registry, check the tables they would make, publish.

    A failed blocking check leaves both typed tables as they were.
    """
    typed = Q.require_schema(TY.typed_production(raw, start, end), PRODUCTION_SCHEMA)
    production = PB.stage(spark, typed, lake.path("silver", "production"))
    registry = durable(TY.typed_registry(raw_registry))
    rows = PB.read(spark, production)
    rows = typed.limit(0) if rows is None else rows.select(*PRODUCTION_SCHEMA.fieldNames())
    found = _gate(lake, run, "typed_production", rows, checks, ["well_id", "production_month"])
    found = found.unionByName(_gate(lake, run, "typed_registry", registry, Q.registry_checks(), ["well_id"]))
    PB.publish(spark, production)
    TB.replace_table(registry, lake.path("silver", "wells"))
    return found


#: Surrogate and business key of each dimension.
DIMENSIONS = {"dim_well": ("well_key", "well_id"), "dim_company": ("company_key", "company_id"), "dim_date": ("date_key", "production_month")}


def build_star(spark: SparkSession, lake: Lake, version: int, run: str, *, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Write the dimensions as a new version, check them and the fact against them, then upsert the fact."""
    production = PB.read_current(spark, lake.path("silver", "production")).select(*PRODUCTION_SCHEMA.fieldNames())
    registry = spark.read.parquet(lake.path("silver", "wells"))
    rows = {"dim_well": ST.dim_well(registry, production), "dim_company": ST.dim_company(production), "dim_date": ST.dim_date(production)}
    written, found = {}, []
    for name, (key, business_key) in DIMENSIONS.items():
        written[name] = TB.upsert_dimension(spark, rows[name], lake.path("gold", name), [key], version)
        found.append(_gate(lake, run, name, written[name], Q.dimension_checks(key, business_key), [business_key]))
    # keys and measures of the stored table, month by month: cheaper to read again than to write
    fact = ST.fact_production(production, start, end)
    found.append(_gate(lake, run, "fact_production", fact, Q.fact_checks(*written.values()), ["production_key"]))
    PB.upsert_periods(spark, fact, lake.path("gold", "fact_production"), ["production_key"], stored=True, by_period=True)
    return reduce(DataFrame.unionByName, found)


def _stale_features(spark: SparkSession, lake: Lake, fact: PB.Snapshot, version: int, stored: PB.Snapshot, cutoffs: Cutoffs) -> IN.FeatureChange | None:
    """What the stored cutoffs that are not asked for owe to changes of the fact and the wells since they were made.

    Only the months that were rewritten since are compared.  Where that state is not kept any more, those cutoffs are
    computed anew.
    """
    rows = PB.read(spark, stored)
    if rows is None:
        return None
    facts, wells = PB.read(spark, fact), TB.read_version(spark, lake.path("gold", "dim_well"), version)
    others = rows.filter(~F.array_contains(cutoff_array(facts, cutoffs), F.col("as_of_date")))
    then, _, wells_then = (stored.made_from or "").partition("/")
    before = PB.at_version(spark, fact.path, int(then)) if then else None
    if before is None:
        fresh = durable(FT.well_features(facts, wells, others.select("as_of_date")))
        return IN.FeatureChange(fresh, others.select(*IN.KEYS).join(fresh, IN.KEYS, "left_anti"))
    months = PB.rewritten(before, fact)
    old, new = (PB.read(spark, snapshot, months) for snapshot in (before, fact))
    changes = IN.changed_months(facts.limit(0) if old is None else old, facts.limit(0) if new is None else new)
    moved = IN.changed_wells(TB.read_version(spark, lake.path("gold", "dim_well"), int(wells_then)), wells)
    return IN.refreshed_features(others, facts, wells, changes, moved)


def build_features(spark: SparkSession, lake: Lake, version: int, run: str, cutoffs: Cutoffs) -> DataFrame:
    """Compute the cutoffs, bring the other stored ones up to date, check and audit both, then publish them as one state.

    The state names the fact and the wells it was made from, so a run that failed in between is made up for by the next.
    """
    state = PB.current(spark, lake.path("gold", "fact_production"))
    stored = PB.current(spark, lake.path("features", "well_features"), "as_of_date")
    fact, wells = PB.read(spark, state), TB.read_version(spark, lake.path("gold", "dim_well"), version)
    rows = durable(FT.well_features(fact, wells, cutoffs))
    leaked = FT.audit_features(rows, fact).select(*IN.KEYS)
    change = _stale_features(spark, lake, state, version, stored, cutoffs)
    if change is not None:
        touched = fact.join(change.rows.select("well_id").distinct(), "well_id", "left_semi")
        # a cutoff's other wells are not missing, they did not change
        leaked = leaked.unionByName(FT.audit_features(change.rows, touched).filter("not missing_in_store").select(*IN.KEYS))
        rows = rows.unionByName(change.rows)
    # stored once: the check counts these rows and the evidence lists them
    audited = [*Q.feature_checks(), Q.absent_from("point_in_time", IN.KEYS, durable(leaked))]
    found = _gate(lake, run, "well_features", rows, audited, IN.KEYS)
    staged = PB.stage(spark, rows, stored.path, "as_of_date", ["well_id"], change and change.removed, stored=True)
    PB.publish(spark, replace(staged, made_from=f"{state.version}/{version}"))
    return found


def run_month(spark: SparkSession, raw: DataFrame, raw_registry: DataFrame, lake: Lake, *, version: int, run: str,
              checks: list[Q.Check], cutoffs: Cutoffs, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """The whole chain; a failed blocking check leaves its own layer and those behind it as they were.

    Returns all results, read from the lake.  Tables staged on the way are gone afterwards, and of the published ones
    what neither the new nor the previous state names.
    """
    with job_scratch(spark, f"month-{run}"):
        found = build_typed(spark, raw, raw_registry, lake, checks, run, start=start, end=end)
        found = found.unionByName(build_star(spark, lake, version, run, start=start, end=end))
        found = found.unionByName(build_features(spark, lake, version, run, cutoffs))
    for at in PUBLISHED:
        PB.expire(spark, lake.path(*at))
    return found

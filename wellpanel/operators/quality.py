"""Declarative checks that keep their failing rows and can block the next layer."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellpanel.functions.columns import all_of, any_of
from wellpanel.schema import FEATURE_CONTRACT, kind_of

ERROR, WARN = "error", "warn"
COMPLETENESS, UNIQUENESS, RANGE, FRESHNESS, INTEGRITY = (
    "completeness", "uniqueness", "range", "freshness", "integrity",
)

# --- fixed values: the published thresholds ------------------------------------

FIRST_MONTH = dt.date(2006, 1, 1)
MIN_MEASURE = 0
MIN_NOT_NULL_SHARE = 0.9
MAX_MONTHS_OLD = 2
MAX_FAILING_PCT = 1.0

# --- end of fixed values ---------------------------------------------------------


class QualityError(RuntimeError):
    """A blocking check failed; the layer behind it must not be written."""


class ContractError(ValueError):
    """Columns or types are not what the contract says."""


@dataclass(frozen=True)
class RowCheck:
    """A rule each row passes or fails on its own."""

    name: str
    dimension: str
    fails: Column
    severity: str = ERROR


@dataclass(frozen=True)
class ShareCheck:
    """At least ``at_least`` of all rows must satisfy ``holds``."""

    name: str
    holds: Column
    at_least: float
    severity: str = ERROR
    dimension: str = COMPLETENESS


@dataclass(frozen=True)
class RecencyCheck:
    """The newest period must not be older than ``oldest``."""

    name: str
    column: str
    oldest: Column
    severity: str = WARN
    dimension: str = FRESHNESS


@dataclass(frozen=True)
class UniqueCheck:
    """No two rows share the key; keys with a NULL part are ignored for single columns."""

    name: str
    columns: tuple[str, ...]
    severity: str = ERROR
    dimension: str = UNIQUENESS


@dataclass(frozen=True)
class ReferenceCheck:
    """Every non-NULL key must exist on the other side."""

    name: str
    column: str
    parent: DataFrame = field(repr=False)
    parent_column: str = ""
    severity: str = ERROR
    dimension: str = INTEGRITY


@dataclass(frozen=True)
class ListedCheck:
    """No row may be among the keys that another computation lists as wrong."""

    name: str
    columns: tuple[str, ...]
    wrong: DataFrame = field(repr=False)
    severity: str = ERROR
    dimension: str = INTEGRITY


Check = RowCheck | ShareCheck | RecencyCheck | UniqueCheck | ReferenceCheck | ListedCheck


def not_null(column: str, severity: str = ERROR) -> RowCheck:
    return RowCheck(f"not_null_{column}", COMPLETENESS, F.col(column).isNull(), severity)


def accepted_range(column: str, low: object = None, high: object = None, severity: str = ERROR) -> RowCheck:
    """Below ``low`` or above ``high`` fails; NULL passes."""
    bounds = []
    if low is not None:
        bounds.append(F.col(column) < F.lit(low))
    if high is not None:
        bounds.append(F.col(column) > F.lit(high))
    return RowCheck(f"accepted_range_{column}", RANGE, F.coalesce(any_of(bounds), F.lit(False)), severity)


def not_null_share(column: str, at_least: float = MIN_NOT_NULL_SHARE, severity: str = ERROR) -> ShareCheck:
    return ShareCheck(f"not_null_share_{column}", F.col(column).isNotNull(), at_least, severity)


def recency(column: str, today: dt.date | str, months: int = MAX_MONTHS_OLD, severity: str = WARN) -> RecencyCheck:
    """``today`` is a parameter, so a check over history is repeatable."""
    return RecencyCheck(f"recency_{column}", column, F.add_months(F.lit(today).cast("date"), -months), severity)


def unique(*columns: str, severity: str = ERROR) -> UniqueCheck:
    return UniqueCheck(f"unique_{'_'.join(columns)}", columns, severity)


def references(column: str, parent: DataFrame, parent_column: str | None = None, severity: str = ERROR) -> ReferenceCheck:
    return ReferenceCheck(f"relationships_{column}", column, parent, parent_column or column, severity)


def absent_from(name: str, columns: list[str], wrong: DataFrame, severity: str = ERROR) -> ListedCheck:
    """``wrong`` holds keys; keys without a row count as failures as well."""
    return ListedCheck(name, tuple(columns), wrong.select(*columns), severity)


def typed_production_checks(today: dt.date | str, first_month: dt.date = FIRST_MONTH) -> list[Check]:
    """The published checks of the typed production table."""
    checks: list[Check] = [not_null(c) for c in ("well_id", "company_id", "production_month")]
    checks.append(accepted_range("production_month", first_month))
    for measure in ("oil_prod_m3", "gas_prod_mm3", "water_prod_m3"):
        checks += [not_null_share(measure), accepted_range(measure, MIN_MEASURE)]
    return [*checks, unique("well_id", "production_month"), recency("production_month", today)]


def registry_checks() -> list[Check]:
    return [not_null("well_id"), unique("well_id")]


def dimension_checks(key: str, business_key: str) -> list[Check]:
    return [not_null(key), unique(key), not_null(business_key)]


def fact_checks(wells: DataFrame, companies: DataFrame, dates: DataFrame) -> list[Check]:
    return [
        not_null("production_key"),
        unique("production_key"),
        references("well_key", wells),
        references("company_key", companies),
        references("date_key", dates),
    ]


def feature_checks() -> list[Check]:
    required = (
        "feature_key", "well_id", "as_of_date", "months_with_history", "well_age_months",
        "months_since_last_observed", "zero_months_12m", "last_observed_month",
    )
    return [*[not_null(c) for c in required], unique("feature_key"), unique("well_id", "as_of_date")]


def require_schema(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Same names and types, or an error listing every difference; returns contract order."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in contract}
    problems = [f"missing {n}" for n in want if n not in have]
    problems += [f"unexpected {n}" for n in have if n not in want]
    problems += [
        f"{n} is {have[n].simpleString()}, expected {want[n].simpleString()}"
        for n in want
        if n in have and have[n] != want[n]
    ]
    if problems:
        raise ContractError("; ".join(problems))
    return df.select(*want)


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Rows whose non-NULL key has no parent."""
    keys = parent.select(F.col(parent_column or column).alias(column))
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def _result(name: str, dimension: str, severity: str, failing: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.lit(dimension).alias("dimension"),
        F.lit(severity).alias("severity"),
        failing.cast("long").alias("failing_rows"),
        passed.alias("passed"),
    )


def _one_scan_results(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All row, share and recency checks as a single aggregation."""
    aggregates, results = [F.count(F.lit(1)).alias("_total")], []
    for i, check in enumerate(checks):
        slot = F.col(f"_c{i}")
        if isinstance(check, RowCheck):
            aggregates.append(F.count_if(check.fails).alias(f"_c{i}"))
            failing, passed = slot, slot == 0
        elif isinstance(check, ShareCheck):
            aggregates.append(F.count_if(check.holds).alias(f"_c{i}"))
            enough = slot >= F.lit(check.at_least) * F.col("_total")
            failing, passed = F.when(enough, 0).otherwise(F.col("_total") - slot), enough
        else:
            aggregates.append(F.max(check.column).alias(f"_c{i}"))
            fresh = F.coalesce(slot >= check.oldest, F.lit(False))
            failing, passed = F.when(fresh, 0).otherwise(1), fresh
        results.append(_result(check.name, check.dimension, check.severity, failing, passed))
    return df.agg(*aggregates).select(F.explode(F.array(*results)).alias("r"), "_total").select(
        "r.*", F.col("_total").alias("total_rows")
    )


def run_checks(df: DataFrame, checks: list[Check], table: str = "") -> DataFrame:
    """One row per check: failing rows, total rows, verdict."""
    together = [c for c in checks if isinstance(c, (RowCheck, ShareCheck, RecencyCheck))]
    parts = [_one_scan_results(df, together)] if together else []
    # a scalar subquery, computed once however many checks read it
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    for check in checks:
        if isinstance(check, UniqueCheck):
            found = duplicates(_keyed(df, check), *check.columns).agg(F.sum("n").alias("n"))
        elif isinstance(check, ReferenceCheck):
            found = orphans(df, check.column, check.parent, check.parent_column).agg(F.count(F.lit(1)).alias("n"))
        elif isinstance(check, ListedCheck):
            found = check.wrong.agg(F.count(F.lit(1)).alias("n"))
        else:
            continue
        failing = F.coalesce("n", F.lit(0))
        parts.append(
            found.select(
                _result(check.name, check.dimension, check.severity, failing, failing == 0).alias("r"),
                total.alias("total_rows"),
            ).select("r.*", "total_rows")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(table).alias("table_name"), "*")


def _keyed(df: DataFrame, check: UniqueCheck) -> DataFrame:
    """A single-column key ignores NULL; a combination compares it."""
    return df.filter(F.col(check.columns[0]).isNotNull()) if len(check.columns) == 1 else df


def failing_rows(df: DataFrame, checks: list[Check], table: str, keys: list[str]) -> DataFrame:
    """Evidence: (table, check, severity, keys, row as JSON), one line per failure.

    Row checks are evaluated together in one scan; a uniqueness failure is each
    row that shares its key.
    """
    shape = [F.lit(table).alias("table_name"), "check_name", "dimension", "severity"]
    parts = []
    rules = [c for c in checks if isinstance(c, RowCheck)]
    if rules:
        hits = F.array_compact(
            F.array(
                *[
                    F.when(
                        c.fails,
                        F.struct(
                            F.lit(c.name).alias("check_name"),
                            F.lit(c.dimension).alias("dimension"),
                            F.lit(c.severity).alias("severity"),
                        ),
                    )
                    for c in rules
                ]
            )
        )
        row = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        parts.append(
            df.filter(any_of([c.fails for c in rules]))
            .select(*[F.col(k).cast("string") for k in keys], row.alias("row_json"), F.explode(hits).alias("hit"))
            .select(*keys, "row_json", "hit.*")
            .select(*shape, *keys, "row_json")
        )
    for check in checks:
        if isinstance(check, UniqueCheck):
            again = duplicates(_keyed(df, check), *check.columns).drop("n").toDF(*[f"_{c}" for c in check.columns])
            # the rows themselves, so that every failure has its period
            same = all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in check.columns])
            found = df.join(again, same, "left_semi")
            columns = df.columns
        elif isinstance(check, ReferenceCheck):
            found = orphans(df, check.column, check.parent, check.parent_column)
            columns = df.columns
        elif isinstance(check, ListedCheck):
            found, columns = check.wrong, check.wrong.columns
        else:
            continue
        kept = [
            (F.col(k).cast("string") if k in found.columns else F.lit(None).cast("string")).alias(k) for k in keys
        ]
        parts.append(
            found.select(
                *kept,
                F.to_json(F.struct(*[F.col(c) for c in columns])).alias("row_json"),
                F.lit(check.name).alias("check_name"),
                F.lit(check.dimension).alias("dimension"),
                F.lit(check.severity).alias("severity"),
            ).select(*shape, *keys, "row_json")
        )
    if not parts:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("check_name", "dimension", "severity", *keys, "row_json")]
        return df.limit(0).select(F.lit(table).alias("table_name"), *nothing)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def failed_checks(results: DataFrame) -> DataFrame:
    """What a notification lists: table, check, severity."""
    return results.filter(~F.col("passed")).select("table_name", "check_name", "severity")


def require_passed(results: DataFrame) -> None:
    """Raise if a blocking check failed; warnings pass."""
    # one row per check
    broken = results.filter(~F.col("passed") & (F.col("severity") == ERROR)).collect()
    if broken:
        listed = ", ".join(f"{r.check_name} ({r.failing_rows} rows)" for r in broken)
        raise QualityError(f"blocking checks failed: {listed}")


def failing_share(failures: DataFrame, table: DataFrame, period: str = "production_month") -> DataFrame:
    """Failing rows of each period as a percentage of the period's rows, per dimension."""
    failed = failures.groupBy(F.col(period).cast("date").alias(period), "dimension").agg(
        F.count(F.lit(1)).alias("failing_rows")
    )
    totals = table.groupBy(F.col(period).alias("_period")).agg(F.count(F.lit(1)).alias("total_rows"))
    pct = F.round(F.col("failing_rows") * 100.0 / F.nullif("total_rows", F.lit(0)), 2)
    # rows without a period are a group of their own and must not vanish
    return failed.join(totals, F.col(period).eqNullSafe(F.col("_period"))).select(period, "dimension", "failing_rows", "total_rows", pct.alias("failing_pct"))


def fitness(failures: DataFrame, table: DataFrame, period: str = "production_month",
            max_pct: float = MAX_FAILING_PCT) -> DataFrame:
    """Per period: fit, fit with a remark, or unfit.

    A few out-of-range rows are tolerable below ``max_pct``; any completeness or
    uniqueness failure is not.
    """
    failed = failures.groupBy(F.col(period).cast("date").alias(period)).agg(
        F.count(F.lit(1)).alias("failing_rows"),
        F.count_if(F.col("dimension") != RANGE).alias("other_failures"),
    )
    totals = table.groupBy(F.col(period).alias("_period")).agg(F.count(F.lit(1)).alias("total_rows"))
    n = F.coalesce("failing_rows", F.lit(0))
    tolerable = (F.col("other_failures") == 0) & (n * 100.0 < F.lit(max_pct) * F.col("total_rows"))
    verdict = F.when(n == 0, "fit").when(tolerable, "fit_with_remark").otherwise("unfit")
    return totals.join(failed, F.col(period).eqNullSafe(F.col("_period")), "left").select(
        F.col("_period").alias(period), n.alias("failing_rows"), "total_rows", verdict.alias("fitness")
    )


def evidence_sample(failures: DataFrame, period_value: dt.date | str, *, period: str = "production_month",
                    key: str = "well_id", limit: int = 50) -> DataFrame:
    """The first ``limit`` failing rows of a period by key."""
    wanted = F.col(period).cast("date") == F.lit(period_value).cast("date")
    return failures.filter(wanted).orderBy(F.asc_nulls_last(key), "check_name", "row_json").limit(limit)


@dataclass(frozen=True)
class Violation:
    """One departure from a contract: ``kind`` is absent, extra, type, null_key or repeated_key."""

    kind: str
    column: str
    found: str = ""
    expected: str = ""

    def __str__(self) -> str:
        return " ".join(part for part in (self.kind, self.column, self.found and f"has {self.found}", self.expected and f"wants {self.expected}") if part)


def feature_contract_violations(features: DataFrame, keys: tuple[str, ...] = ("well_id", "as_of_date")) -> list[Violation]:
    """All departures of the stored columns and keys from the feature contract."""
    stored = {f.name: f.dataType for f in features.schema}
    found = [
        Violation("type", name, stored[name].simpleString(), kind)
        for name, kind in FEATURE_CONTRACT.items()
        if name in stored and kind_of(stored[name]) != kind
    ]
    found += [Violation("absent", name) for name in FEATURE_CONTRACT if name not in stored]
    found += [Violation("extra", name) for name in stored if name not in FEATURE_CONTRACT]
    if all(k in stored for k in keys):
        repeats = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
        counts = repeats.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys], F.count_if(F.col("times") > 1).alias("again")).first()
        found += [Violation("null_key", k, f"{counts[k]} groups") for k in keys if counts[k]]
        if counts.again:
            found.append(Violation("repeated_key", "+".join(keys), f"{counts.again} groups"))
    return found


def require_feature_contract(features: DataFrame) -> DataFrame:
    """Canonical column order, or an error listing all violations."""
    found = feature_contract_violations(features)
    if found:
        raise ContractError("features: " + ", ".join(map(str, found)))
    return features.select(*FEATURE_CONTRACT)


def _profile_text(c: Column, data_type: T.DataType) -> Column:
    """A column as text that sorts nowhere but reads the same in every engine."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return c.cast("decimal(38,6)").cast("string")
    return c.cast("string")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count, nulls, distinct values, min and max of each column.

    Every column is profiled.  Null counts and extremes take one aggregation.
    Distinct counts go through (column, digest) groups that map tasks combine
    first: a value filling a third of a column travels once per task, and a long
    text as 16 bytes.
    """
    chosen = columns or df.columns
    types = {c: df.schema[c].dataType for c in chosen}
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n_{c}") for c in chosen],
        *[F.min(c).alias(f"lo_{c}") for c in chosen],
        *[F.max(c).alias(f"hi_{c}") for c in chosen],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col("_rows") - F.col(f"n_{c}")).alias("null_count"),
                _profile_text(F.col(f"lo_{c}"), types[c]).alias("min_value"),
                _profile_text(F.col(f"hi_{c}"), types[c]).alias("max_value"),
            )
            for c in chosen
        ]
    )
    basic = stats.select(F.col("_rows").alias("row_count"), F.explode(entries).alias("e")).select("row_count", "e.*")
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.unhex(F.md5(F.col(c).cast("string"))).alias("v")) for c in chosen])
        ).alias("cell")
    ).select("cell.*")
    distinct = cells.filter(F.col("v").isNotNull()).distinct().groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count")
    )
    return basic.join(distinct, "column_name", "left").select(
        "column_name", "row_count", "null_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "min_value", "max_value",
    )

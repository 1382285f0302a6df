"""Report questions and serving reads over the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellpanel.functions.columns import contains_text
from wellpanel.operators.star import lifetime_totals
from wellpanel.schema import FLUID_LABELS
from wellpanel.sources.tables import month_range

Day = dt.date | str


def unpivot_fluids(df: DataFrame, keep: list[str], measures: dict[str, str], value: str = "volume",
                   fluid: str | None = None) -> DataFrame:
    """One row per fluid; NULL volumes are kept.

    ``measures`` maps columns to labels.  A wanted ``fluid`` narrows the columns
    before anything is read, so the other measures never leave the scan.
    """
    wanted = {c: label for c, label in measures.items() if fluid is None or label == fluid}
    if not wanted:
        return df.select(*keep, F.lit("").alias("fluid_type"), F.lit(None).cast("double").alias(value)).limit(0)
    pairs = F.array(
        *[F.struct(F.lit(label).alias("fluid_type"), F.col(c).alias(value)) for c, label in wanted.items()]
    )
    return df.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.fluid_type", f"_f.{value}")


def production_by_fluid(fact: DataFrame, wells: DataFrame, companies: DataFrame, dates: DataFrame, *,
                        well_name: str | None = None, month: Day | None = None,
                        fluid: str | None = None) -> DataFrame:
    """Monthly volumes per well and fluid; every filter is optional."""
    named = wells.select("well_key", "well_alias")
    if well_name is not None:
        named = named.filter(contains_text("well_alias", well_name))
    calendar = dates.select("date_key", "production_month")
    if month is not None:
        wanted = F.lit(month).cast("date")
        calendar = calendar.filter(F.col("production_month") == wanted)
        fact = fact.filter(F.col("production_month") == wanted)
    joined = (
        fact.drop("production_month", "well_id")
        .join(F.broadcast(calendar), "date_key")  # one row per calendar month
        .join(companies.select("company_key", "company_name"), "company_key")
        .join(named, "well_key")
    )
    return unpivot_fluids(joined, ["well_alias", "company_name", "production_month"], FLUID_LABELS, fluid=fluid)


def production_order(report: DataFrame) -> DataFrame:
    """Newest month first, then alias and fluid: a global sort, for display only."""
    return report.orderBy(F.desc("production_month"), F.asc_nulls_last("well_alias"), "fluid_type")


_TOTALS = {
    "total_oil_m3": FLUID_LABELS["oil_prod_m3"],
    "total_gas_mm3": FLUID_LABELS["gas_prod_mm3"],
    "total_water_m3": FLUID_LABELS["water_prod_m3"],
}


def history_by_fluid(fact: DataFrame, dates: DataFrame, *, since: Day | None = None,
                     fluid: str | None = None) -> DataFrame:
    """Monthly totals per fluid.

    Summing before the unpivot shuffles one partial row per month and task
    instead of three per fact row.
    """
    totals = lifetime_totals(month_range(fact, since, None), "date_key").join(
        F.broadcast(dates.select("date_key", "production_month")), "date_key"
    )
    return unpivot_fluids(totals, ["production_month"], _TOTALS, "total_volume", fluid)


def totals_by_alias(fact: DataFrame, wells: DataFrame, *, well_name: str | None = None,
                    fluid: str | None = None) -> DataFrame:
    """Lifetime totals per well alias and fluid; wells sharing an alias are added up."""
    named = wells.select("well_key", "well_alias")
    if well_name is not None:
        named = named.filter(contains_text("well_alias", well_name))
    by_alias = lifetime_totals(fact).join(named, "well_key").groupBy("well_alias").agg(
        *[F.sum(c).alias(c) for c in _TOTALS]
    )
    return unpivot_fluids(by_alias, ["well_alias"], _TOTALS, "total_volume", fluid)


def top_by_fluid(fact: DataFrame, wells: DataFrame, *, well_name: str | None = None,
                 fluid: str | None = None, limit: int = 20) -> DataFrame:
    """The largest totals.

    Groups without any volume go last; the source database would list them
    first, which is never what a top list is for.
    """
    return (
        totals_by_alias(fact, wells, well_name=well_name, fluid=fluid)
        .orderBy(F.desc_nulls_last("total_volume"), F.asc_nulls_last("well_alias"), "fluid_type")
        .limit(limit)
    )


def control_totals(fact: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Rows and oil per month of a half-open range."""
    return month_range(fact, start, end).groupBy("production_month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("oil_prod_m3").alias("oil_prod_m3")
    )


def well_list(wells: DataFrame) -> DataFrame:
    """All well ids in order."""
    return wells.select("well_id").orderBy("well_id")


def known_wells(requests: DataFrame, wells: DataFrame) -> DataFrame:
    """Requests whose well exists."""
    return requests.join(wells.select("well_id"), "well_id", "left_semi")


def production_window(requests: DataFrame, fact: DataFrame) -> DataFrame:
    """Actuals of each request's well between its dates, both included; NULL reads as 0.

    ``requests`` needs ``well_id``, ``date_start`` and ``date_end``.  A request
    whose dates are reversed raises in the task that meets it.
    """
    checked = requests.select(
        "*",
        F.when(F.col("date_start") > F.col("date_end"), F.raise_error(F.lit("date_start must be before date_end")))
        .otherwise(F.lit(True))
        .alias("_ok"),
    ).filter("_ok")
    # the months asked for, not the history of the well, decide what a request costs
    first = F.add_months(F.trunc("date_start", "MM"), F.when(F.dayofmonth("date_start") > 1, 1).otherwise(0))
    last = F.trunc("date_end", "MM")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    asked = checked.select(*requests.columns, F.explode(months).alias("production_month"))
    series = fact.select("well_id", "production_month", "oil_prod_m3")
    return asked.join(series, ["well_id", "production_month"]).select(
        *requests.columns,
        F.col("production_month").alias("date"),
        F.coalesce(F.col("oil_prod_m3").cast("double"), F.lit(0.0)).alias("prod"),
    )


def feature_lookup(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Stored feature rows of each (well, cutoff) asked for; absent ones have no row."""
    return requests.select("well_id", "as_of_date").join(features, ["well_id", "as_of_date"])

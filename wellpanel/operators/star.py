"""Typed tables -> star schema and its two report views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellpanel.functions.columns import surrogate_key
from wellpanel.operators.latest import latest_per_key
from wellpanel.operators.ordering import global_rank
from wellpanel.schema import MEASURES
from wellpanel.sources.tables import month_range

_SHARED = ("well_alias", "field", "basin", "province")
_REGISTRY_ONLY = (
    "depth_m", "latitude", "longitude", "classification", "sub_classification", "reservoir_type",
)
_PRODUCTION_ONLY = ("formation", "resource_type")


def latest_attributes(production: DataFrame) -> DataFrame:
    """Attributes of each well's latest month."""
    columns = ["well_id", "production_month", *_SHARED, *_PRODUCTION_ONLY]
    newest = latest_per_key(production.select(*columns), ["well_id"], [F.desc("production_month")])
    return newest.drop("production_month")


def well_universe(registry: DataFrame, production: DataFrame) -> DataFrame:
    """Every well known to either side, once."""
    return registry.select("well_id").union(production.select("well_id")).distinct()


def dim_well(registry: DataFrame, production: DataFrame) -> DataFrame:
    """One row per well of either side; registry attributes win where both have one.

    Both inputs hold one row per well, so a single full outer join yields the
    universe and the attributes together.
    """
    r, p = registry.alias("r"), latest_attributes(production).alias("p")
    well = F.coalesce("r.well_id", "p.well_id")
    return r.join(p, F.col("r.well_id") == F.col("p.well_id"), "full_outer").select(
        surrogate_key(well).alias("well_key"),
        well.alias("well_id"),
        *[F.coalesce(f"r.{c}", f"p.{c}").alias(c) for c in _SHARED],
        *[F.col(f"r.{c}") for c in _REGISTRY_ONLY],
        *[F.col(f"p.{c}") for c in _PRODUCTION_ONLY],
    )


def dim_company(production: DataFrame) -> DataFrame:
    """One row per company with its first non-NULL name in ascending order.

    Pairs are counted before the minimum is taken: counting runs as a hash
    aggregate, so a company holding a third of the rows shrinks to a few pairs per
    map task.  A minimum over text alone would sort every row first, and a plain
    ``distinct`` in front of it is optimised away.
    """
    pairs = (
        production.filter(F.col("company_id").isNotNull())
        .groupBy("company_id", "company_name")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > 0)
    )
    return pairs.groupBy("company_id").agg(F.min("company_name").alias("company_name")).select(
        surrogate_key("company_id").alias("company_key"), "company_id", "company_name"
    )


def dim_date(production: DataFrame) -> DataFrame:
    """Calendar attributes of every month that occurs."""
    month = F.col("production_month")
    return (
        production.select(month).filter(month.isNotNull()).distinct()
        .select(
            surrogate_key("production_month").alias("date_key"),
            month,
            F.year(month).alias("year"),
            F.month(month).alias("month"),
            F.quarter(month).alias("quarter"),
            F.date_format(month, "MMMM").alias("month_name"),
        )
    )


def fact_production(
    production: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> DataFrame:
    """Monthly fact with keys that resolve against the dimensions."""
    return month_range(production, start, end).select(
        surrogate_key("well_id", "production_month").alias("production_key"),
        surrogate_key("well_id").alias("well_key"),
        surrogate_key("company_id").alias("company_key"),
        surrogate_key("production_month").alias("date_key"),
        "well_id",
        "production_month",
        *MEASURES,
    )


def monthly_production_by_well(
    fact: DataFrame, wells: DataFrame, companies: DataFrame, dates: DataFrame
) -> DataFrame:
    """Fact with readable attributes.

    The date dimension has one row per calendar month and is broadcast.  Wells
    and companies grow with the data, so Spark picks their strategy from
    statistics, and AQE splits the partitions of a company that dominates.
    """
    calendar = dates.select("date_key", "year", "month", "month_name")
    return (
        fact.join(F.broadcast(calendar), "date_key")
        .join(companies.select("company_key", "company_name"), "company_key")
        .join(wells.select("well_key", "well_alias", "field", "basin", "province"), "well_key")
        .select(
            "production_month", "year", "month", "month_name", "well_id", "well_alias",
            "field", "basin", "province", "company_name", *MEASURES,
        )
    )


def lifetime_totals(fact: DataFrame, key: str = "well_key") -> DataFrame:
    """Totals of the three measures; units differ, so they are never added up."""
    return fact.groupBy(key).agg(
        F.sum("oil_prod_m3").alias("total_oil_m3"),
        F.sum("gas_prod_mm3").alias("total_gas_mm3"),
        F.sum("water_prod_m3").alias("total_water_m3"),
    )


def top_wells_by_volume(fact: DataFrame, wells: DataFrame) -> DataFrame:
    """Every well ranked by lifetime oil, wells without any last, ties by well id."""
    named = lifetime_totals(fact).join(
        wells.select("well_key", "well_id", "well_alias", "field", "basin", "province"), "well_key"
    ).drop("well_key")
    return global_rank(named, [F.desc_nulls_last("total_oil_m3"), F.asc("well_id")], "oil_volume_rank")

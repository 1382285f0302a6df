"""Feature rows + the series -> supervised rows, and their chronological split."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellpanel.schema import FEATURE_CONTRACT

HORIZONS = range(1, 13)


def check_horizons(horizons: Iterable[int]) -> list[int]:
    wanted = sorted(set(horizons))
    if not wanted or wanted[0] < HORIZONS.start or wanted[-1] >= HORIZONS.stop:
        raise ValueError(f"horizons must lie within 1..12, got {wanted}")
    return wanted


def expand_horizons(features: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Each feature row once per horizon; horizon 1 is the cutoff month itself."""
    wanted = F.array(*[F.lit(h) for h in check_horizons(horizons)])
    return features.select("*", F.explode(wanted).alias("horizon")).select(
        "*", F.add_months("as_of_date", F.col("horizon") - 1).alias("target_month")
    )


def asof_before(
    requests: DataFrame, series: DataFrame, value: str, name: str, *, skip_nulls: bool = False
) -> DataFrame:
    """Add to each request its well's newest value strictly before ``as_of_date``.

    Distinct questions and observations are merged into one timeline per well, so a
    single sort answers them; a join on ``month < cutoff`` would first produce every
    earlier month for every request.  The answers are joined back to the requests,
    where a well with very many of them can be split.  By default the newest
    *row* decides and its value may be NULL; ``skip_nulls`` takes the newest
    value instead.
    """
    observed = series.select(
        "well_id",
        F.col("production_month").alias("_at"),
        F.lit(1).alias("_kind"),
        F.struct(F.col(value).alias("v")).alias("_seen"),
    )
    if skip_nulls:
        observed = observed.filter(F.col("_seen.v").isNotNull())
    keys = ["well_id", "as_of_date"]
    # distinct questions of a well are bounded by the calendar, however many requests ask them
    asked = requests.select(*keys).distinct().select("*", F.col("as_of_date").alias("_at"), F.lit(0).alias("_kind"))
    # a request sorts before an observation of the same month: strictly before
    w = Window.partitionBy("well_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    timeline = asked.unionByName(observed, allowMissingColumns=True)
    answers = (
        timeline.withColumn("_answer", F.last("_seen", ignorenulls=True).over(w))
        .filter((F.col("_kind") == 0) & F.col("_answer").isNotNull())
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_answer.v").alias(name))
    )
    same = (F.col("well_id") == F.col("_well_id")) & (F.col("as_of_date") == F.col("_as_of_date"))
    return requests.join(answers, same, "left").select(*requests.columns, name)


def targets_by_cutoff(series: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Observed values keyed by the (cutoff, horizon) pairs they are the target of.

    Expanding the narrow series instead of the wide features keeps the shuffle of
    feature rows at one copy each.  Merge joins only: Spark sizes the expanded rows
    by the compressed columns they are read from, and would broadcast a hundred
    times what it expects into every task.
    """
    wanted = F.array(*[F.lit(h) for h in check_horizons(horizons)])
    observed = series.filter(F.col("oil_prod_m3").isNotNull())
    return observed.select(
        "well_id",
        F.col("production_month").alias("target_month"),
        F.col("oil_prod_m3").cast("double").alias("oil_prod_m3_target"),
        F.explode(wanted).alias("horizon"),
    ).select(
        "well_id",
        F.add_months("target_month", 1 - F.col("horizon")).alias("as_of_date"),
        "horizon",
        "target_month",
        "oil_prod_m3_target",
    ).hint("merge")


def training_dataset(
    features: DataFrame, series: DataFrame, horizons: Iterable[int], *, skip_nulls: bool = False
) -> DataFrame:
    """One row per (well, cutoff, horizon) with an observed target and the naive forecast."""
    wanted = check_horizons(horizons)
    contract = features.select(*FEATURE_CONTRACT)
    values = series.withColumn("oil_prod_m3", F.col("oil_prod_m3").cast("double"))
    with_naive = asof_before(contract, values, "oil_prod_m3", "naive_forecast_m3", skip_nulls=skip_nulls)
    return with_naive.join(targets_by_cutoff(series, wanted), ["well_id", "as_of_date"]).select(
        *FEATURE_CONTRACT, "horizon", "target_month", "oil_prod_m3_target", "naive_forecast_m3"
    )


def dataset_order(dataset: DataFrame) -> DataFrame:
    """The published row order; only for sinks and comparisons."""
    return dataset.orderBy("as_of_date", "well_id", "horizon")


def split_cutoffs(cutoffs: DataFrame, as_of: dt.date | str, validation_cutoffs: int = 0) -> DataFrame:
    """Label each distinct cutoff up to ``as_of``: test, validation or train.

    One row per cutoff, so the unpartitioned window sees at most a calendar.
    """
    test = F.lit(as_of).cast("date")
    age = F.row_number().over(Window.orderBy(F.desc("as_of_date")))
    known = cutoffs.select("as_of_date").distinct().filter(F.col("as_of_date") <= test)
    ranked = known.withColumn("_age", age)
    return ranked.select(
        "as_of_date",
        F.when(F.col("as_of_date") == test, "test")
        .when(F.col("_age") <= validation_cutoffs + 1, "validation")
        .otherwise("train")
        .alias("split"),
    )


def temporal_split(
    dataset: DataFrame, as_of: dt.date | str, *, validation_cutoffs: int = 0, purge_overlap: bool = False
) -> DataFrame:
    """Add ``split``; later cutoffs are dropped.

    Raises when the evaluated cutoff has no rows or nothing older is left to
    train on.  By default only cutoffs decide, as published; ``purge_overlap``
    also drops training rows whose target month lies in the tested period.
    """
    labels = split_cutoffs(dataset, as_of, validation_cutoffs)
    # one label per cutoff: a calendar-bounded lookup
    found = {r.as_of_date: r.split for r in labels.collect()}
    if "test" not in found.values():
        raise ValueError(f"nothing to evaluate: the dataset has no cutoff {as_of}")
    if "train" not in found.values():
        raise ValueError(f"nothing to train on: every cutoff before {as_of} is held back for validation ({validation_cutoffs}) or absent")
    by_name = {
        name: [F.lit(day) for day, label in sorted(found.items()) if label == name]
        for name in ("train", "validation", "test")
    }
    label = F.lit(None).cast("string")
    for name, days in by_name.items():
        if days:
            label = F.when(F.col("as_of_date").isin(*days), name).otherwise(label)
    # a plain IN filter, so partition pruning on as_of_date still works
    every = [day for days in by_name.values() for day in days]
    out = dataset.filter(F.col("as_of_date").isin(*every)).withColumn("split", label)
    if purge_overlap:
        out = out.filter((F.col("split") != "train") | (F.col("target_month") < F.lit(as_of).cast("date")))
    return out


def dataset_footprint(dataset: DataFrame) -> DataFrame:
    """Rows, distinct wells, and the sorted cutoffs and horizons of a dataset.

    Rows are first counted per well, which map tasks combine before the shuffle.
    """
    wells = dataset.groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))
    totals = wells.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("wells"))

    def listed(column: str) -> DataFrame:
        # bounded by the calendar, or by 12 horizons
        return dataset.select(column).distinct().agg(F.sort_array(F.collect_set(column)).alias("v"))

    return totals.select(
        "rows",
        "wells",
        listed("as_of_date").scalar().alias("cutoffs"),
        listed("horizon").scalar().alias("horizons"),
    )

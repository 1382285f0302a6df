"""Knowledge cutoffs and the per-well running history they look back on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellpanel.functions.columns import month_start

Cutoffs = dt.date | str | Iterable[dt.date | str] | DataFrame | None


def default_cutoff(production: DataFrame) -> DataFrame:
    """One row: the month after the newest month."""
    return production.agg(F.add_months(month_start(F.max("production_month")), 1).alias("as_of_date"))


def is_single(cutoffs: Cutoffs) -> bool:
    return cutoffs is None or isinstance(cutoffs, (str, dt.date)) or (
        isinstance(cutoffs, (list, tuple)) and len(cutoffs) == 1
    )


def single_cutoff(production: DataFrame, cutoff: Cutoffs) -> Column:
    """The one cutoff as an expression, normalised to the first of its month."""
    if cutoff is None:
        return default_cutoff(production).scalar()
    value = cutoff[0] if isinstance(cutoff, (list, tuple)) else cutoff
    return F.trunc(F.lit(value).cast("date"), "MM")


def cutoff_array(production: DataFrame, cutoffs: Cutoffs) -> Column:
    """All cutoffs as one sorted array expression.

    Cutoffs are month starts, so their number is bounded by the calendar.  A
    DataFrame becomes a scalar subquery and never visits the driver.
    """
    if isinstance(cutoffs, DataFrame):
        months = month_start("as_of_date")
        return cutoffs.agg(F.sort_array(F.collect_set(months)).alias("cutoffs")).scalar()
    if is_single(cutoffs):
        return F.array(single_cutoff(production, cutoffs))
    days = sorted({str(c) for c in cutoffs})
    months = sorted({f"{d[:7]}-01" for d in days})
    return F.array(*[F.lit(m).cast("date") for m in months])


def visible_at(rows: DataFrame, cutoffs: Column, look_back: int, extra: list[str]) -> DataFrame:
    """Pair every observation with the cutoffs that need to see it.

    A cutoff needs the observations of its last ``look_back`` months, plus the
    newest observation before it, which carries the running history.  Each row
    therefore serves the cutoffs after its own month up to the later of
    ``look_back`` months on and its successor's month: about ``look_back`` copies
    per row however many cutoffs are asked for, instead of one per later cutoff.

    ``rows`` needs ``well_id``, ``production_month`` and ``next_month``.
    """
    last = F.array_max(cutoffs)
    reach = F.greatest(
        F.add_months("production_month", look_back), F.coalesce("next_month", last)
    )
    months = F.sequence(
        F.add_months("production_month", 1), F.least(reach, last), F.expr("interval 1 month")
    )
    seen = rows.filter(F.col("production_month") < last)
    return seen.select(
        "well_id",
        "production_month",
        *extra,
        F.explode(F.array_intersect(months, cutoffs)).alias("as_of_date"),
    )


#: Rows of a well panel that one task takes: with two dozen cutoffs, about as many feature rows and their sums.
PANEL_ROWS_A_TASK = 200_000


def spread_by_well(rows: DataFrame) -> DataFrame:
    """``rows`` in as many tasks as their number asks for, a well in one of them.

    What is built per well grows in the task: months are copied to cutoffs and summed in dozens of columns.  AQE sizes
    tasks by the narrow rows that are shuffled, so a task would grow with the table.  ``rows`` are counted, so they
    should be stored ones.  Small tables are left to AQE.
    """
    spark = rows.sparkSession
    wanted = -(-rows.count() // PANEL_ROWS_A_TASK)
    if wanted <= spark.sparkContext.defaultParallelism:
        return rows
    # no fewer than the default: joins with wells keep this partitioning only then
    return rows.repartition(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))), "well_id")


def well_months() -> Window:
    """A well's months in order: one group per well, bounded by the calendar."""
    return Window.partitionBy("well_id").orderBy("production_month")

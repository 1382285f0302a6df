"""Point-in-time features: what was known about a well before each cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellpanel.functions.columns import (
    any_of, differs, differs_beyond, month_index, months_between_int, surrogate_key,
)
from wellpanel.operators.cutoffs import (
    Cutoffs, cutoff_array, is_single, single_cutoff, spread_by_well, visible_at, well_months,
)
from wellpanel.schema import (
    COUNT_FEATURES, FEATURE_CONTRACT, LAG_MONTHS, MEAN_MONTHS, STATIC_FEATURES, STD_MONTHS,
    TREND_MONTHS, VOLUME_FEATURES,
)


#: Volumes are counted in millionths and split into two limbs, u = h * LIMB + l, so that squares and products of a
#: year's months are exact sums of longs.
UNIT, LIMB_BITS = 1_000_000, 27
LIMB = 1 << LIMB_BITS


def _limbs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.shiftright("u", LIMB_BITS)).withColumn("l", F.col("u").bitwiseAND(LIMB - 1))


def _window_aggregates() -> list[Column]:
    """Lags, means, deviations, slopes and zero counts as one conditional aggregation over ``u, h, l``.

    A window has at most 12 months and a limb 27 bits, so every sum and every product of two sums fits a long; limbs
    are combined once per group.  Exact sums also do not show the order in which a shuffle delivers rows.
    """
    month, as_of, u = F.col("production_month"), F.col("as_of_date"), F.col("u")

    def within(k: int, value: Column = u) -> Column:
        return F.when((month >= F.add_months(as_of, -k)) & u.isNotNull(), value)

    # the slope is the same on any origin; months before the cutoff keep the numbers small
    x = (month_index(month) - month_index(as_of)).cast("long")
    h, l = F.col("h"), F.col("l")  # noqa: E741

    def combined(*limbs: Column) -> Column:
        """Limbs from the highest down, as one exact integer."""
        total = limbs[0].cast("decimal(38,0)")
        for limb in limbs[1:]:
            total = (total * F.lit(LIMB).cast("decimal(9,0)")).cast("decimal(38,0)") + limb.cast("decimal(38,0)")
        return total.cast("double")

    def mean(k: int) -> Column:
        return F.sum(within(k)).cast("double") / UNIT / F.count(within(k))

    def deviation(k: int) -> Column:
        n, high, low = F.count(within(k)), F.sum(within(k, h)), F.sum(within(k, l))
        spread = combined(
            n * F.sum(within(k, h * h)) - high * high, 2 * (n * F.sum(within(k, h * l)) - high * low), n * F.sum(within(k, l * l)) - low * low
        )
        return F.when(n > 1, F.sqrt(spread / (float(UNIT) ** 2) / (n * (n - 1))))

    def slope(k: int) -> Column:
        n, total = F.count(within(k)), F.sum(within(k, x))
        rise = combined(
            n * F.sum(within(k, x * h)) - total * F.sum(within(k, h)), n * F.sum(within(k, x * l)) - total * F.sum(within(k, l))
        )
        return F.when(n > 1, rise / UNIT / (n * F.sum(within(k, x * x)) - total * total))

    return [
        *[
            (F.max(F.when(month == F.add_months(as_of, -k), u)).cast("double") / UNIT).alias(f"oil_prod_m3_lag_{k}m")
            for k in LAG_MONTHS
        ],
        *[mean(k).alias(f"oil_prod_m3_roll_mean_{k}m") for k in MEAN_MONTHS],
        *[deviation(k).alias(f"oil_prod_m3_roll_std_{k}m") for k in STD_MONTHS],
        *[slope(k).alias(f"oil_prod_m3_trend_{k}m") for k in TREND_MONTHS],
        F.count_if((u == 0) & (month >= F.add_months(as_of, -12))).alias("zero_months_12m"),
    ]


def _one_cutoff(panel: DataFrame, cutoff: Column) -> DataFrame:
    """Single cutoff: filter and aggregate, with map-side partial aggregation."""
    known = panel.filter(F.col("production_month") < cutoff).withColumn("as_of_date", cutoff)
    return _limbs(known).groupBy("well_id", "as_of_date").agg(
        *_window_aggregates(),
        F.count(F.lit(1)).alias("months_with_history"),
        F.min("production_month").alias("first_month"),
        F.max("production_month").alias("last_observed_month"),
    )


def _many_cutoffs(panel: DataFrame, cutoffs: Column) -> DataFrame:
    """Many cutoffs in one pass over one shuffle on the well.

    The history of all earlier months travels as running values on each
    observation, so only a year of observations is copied per cutoff.
    """
    w = well_months()
    rows = spread_by_well(panel).filter(F.col("production_month") < F.array_max(cutoffs)).select(
        "well_id",
        "production_month",
        "u",
        F.row_number().over(w).alias("seen"),
        F.first("production_month").over(w).alias("first_month"),
        F.lead("production_month").over(w).alias("next_month"),
    )
    return _limbs(visible_at(rows, cutoffs, 12, ["u", "seen", "first_month"])).groupBy("well_id", "as_of_date").agg(
        *_window_aggregates(),
        F.max("seen").cast("long").alias("months_with_history"),
        F.min("first_month").alias("first_month"),
        F.max("production_month").alias("last_observed_month"),
    )


def history_features(fact: DataFrame, as_of_dates: Cutoffs = None) -> DataFrame:
    """Feature rows without static attributes, one per (well, cutoff) with any history."""
    units = (F.col("oil_prod_m3").cast("decimal(16,6)") * UNIT).cast("long")
    panel = fact.select("well_id", "production_month", units.alias("u"))
    if is_single(as_of_dates):
        stats = _one_cutoff(panel, single_cutoff(fact, as_of_dates))
    else:
        stats = _many_cutoffs(panel, cutoff_array(fact, as_of_dates))
    return stats.select(
        "well_id",
        "as_of_date",
        *VOLUME_FEATURES,
        "months_with_history",
        months_between_int("as_of_date", "first_month").alias("well_age_months"),
        months_between_int("as_of_date", "last_observed_month").alias("months_since_last_observed"),
        "zero_months_12m",
        "last_observed_month",
    )


def well_features(fact: DataFrame, wells: DataFrame, as_of_dates: Cutoffs = None) -> DataFrame:
    """The feature table for one or many cutoffs; without any, the month after the newest.

    ``fact`` must hold one row per (well, month) and first-of-month dates.
    """
    statics = wells.select("well_id", *STATIC_FEATURES)
    return history_features(fact, as_of_dates).join(statics, "well_id", "left").select(
        surrogate_key("well_id", "as_of_date").alias("feature_key"), *FEATURE_CONTRACT
    )


def monthly_counts_at_cutoffs(fact: DataFrame, as_of_dates: Cutoffs) -> DataFrame:
    """How many fact rows, and how much oil, lie strictly before each cutoff.

    Months are totalled first, so the range join runs between two tables that
    are both bounded by the calendar.
    """
    months = fact.groupBy("production_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("oil_prod_m3").alias("oil")
    )
    paired = months.select("*", F.explode(cutoff_array(fact, as_of_dates)).alias("as_of_date"))
    return (
        paired.filter(F.col("production_month") < F.col("as_of_date"))
        .groupBy("as_of_date")
        .agg(F.sum("n").alias("known_rows"), F.sum("oil").alias("known_oil_m3"))
    )


def rolling_peak(fact: DataFrame, rows: int = 12) -> DataFrame:
    """Highest of each well's last ``rows`` producing months."""
    w = Window.partitionBy("well_id").orderBy(F.desc("production_month"))
    return (
        fact.filter(F.col("oil_prod_m3") > 0)
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= rows)
        .groupBy("well_id")
        .agg(F.max("oil_prod_m3").alias("recent_peak_m3"), F.count(F.lit(1)).alias("producing_months"))
    )


def _two_pass_statistics() -> list[Column]:
    """The audit's own formulas over ``points(x, y)`` of the last year: deviations from the mean, in doubles."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def window(k: int) -> Column:
        return F.filter("points", lambda p: (p["x"] >= -k) & p["y"].isNotNull())

    def moments(k: int, finish) -> Column:
        # a one-element array binds the window's means, so that each is computed once
        points = window(k)
        n = F.size(points)
        at = F.struct(total(F.transform(points, lambda p: p["x"].cast("double"))).alias("x"), total(F.transform(points, lambda p: p["y"])).alias("y"))
        bound = F.transform(F.array(at), lambda s: finish(points, n, s["x"] / n, s["y"] / n))
        return F.when(n > 1, F.get(bound, 0))

    def deviation(points: Column, n: Column, _: Column, y: Column) -> Column:
        return F.sqrt(total(F.transform(points, lambda p: (p["y"] - y) * (p["y"] - y))) / (n - 1))

    def slope(points: Column, n: Column, x: Column, y: Column) -> Column:
        return total(F.transform(points, lambda p: (p["x"] - x) * (p["y"] - y))) / total(F.transform(points, lambda p: (p["x"] - x) * (p["x"] - x)))

    def mean(k: int) -> Column:
        values = F.transform(window(k), lambda p: p["y"])
        return F.when(F.size(values) > 0, total(values) / F.size(values))

    def lag(k: int) -> Column:
        return F.get(F.filter("points", lambda p: p["x"] == -k), 0)["y"]

    return [
        *[lag(k).alias(f"oil_prod_m3_lag_{k}m") for k in LAG_MONTHS],
        *[mean(k).alias(f"oil_prod_m3_roll_mean_{k}m") for k in MEAN_MONTHS],
        *[moments(k, deviation).alias(f"oil_prod_m3_roll_std_{k}m") for k in STD_MONTHS],
        *[moments(k, slope).alias(f"oil_prod_m3_trend_{k}m") for k in TREND_MONTHS],
        F.size(F.filter("points", lambda p: p["y"] == 0)).cast("long").alias("zero_months_12m"),
    ]


def recomputed_features(fact: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """:func:`history_features` by other formulas, for the audit: a year's points as an array, at most 12 a row."""
    w = well_months()
    rows = spread_by_well(fact.select("well_id", "production_month", F.col("oil_prod_m3").cast("double").alias("y"))).select(
        "*", F.row_number().over(w).alias("seen"), F.first("production_month").over(w).alias("first_month"), F.lead("production_month").over(w).alias("next_month")
    )
    seen = visible_at(rows, cutoff_array(fact, cutoffs), 12, ["y", "seen", "first_month"])
    x = month_index(F.col("production_month")) - month_index(F.col("as_of_date"))
    grouped = seen.groupBy("well_id", "as_of_date").agg(
        F.sort_array(F.collect_list(F.when(x >= -12, F.struct(x.alias("x"), "y")))).alias("points"),
        F.max("seen").cast("long").alias("months_with_history"), F.min("first_month").alias("first_month"), F.max("production_month").alias("last_observed_month"),
    )
    return grouped.select(
        "well_id", "as_of_date", *_two_pass_statistics(), "months_with_history", months_between_int("as_of_date", "first_month").alias("well_age_months"),
        months_between_int("as_of_date", "last_observed_month").alias("months_since_last_observed"), "last_observed_month",
    )


def audit_features(stored: DataFrame, fact: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows where the stored table and a recomputation from the fact disagree.

    Every stored cutoff is recomputed from the months strictly before it, by formulas of its own; wells
    missing on either side are failures too.
    """
    fresh = recomputed_features(fact, stored.select("as_of_date").distinct())
    exact = [*COUNT_FEATURES, "last_observed_month"]
    keys = ["well_id", "as_of_date"]
    s = stored.select(*keys, *VOLUME_FEATURES, *exact).withColumn("_stored", F.lit(True)).alias("s")
    f = fresh.withColumn("_fresh", F.lit(True)).alias("f")
    joined = s.join(f, [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys], "full_outer")
    # named per column so that a failure says what diverged
    broken = {
        **{c: differs_beyond(F.col(f"s.{c}"), F.col(f"f.{c}"), tolerance) for c in VOLUME_FEATURES},
        **{c: differs(F.col(f"s.{c}"), F.col(f"f.{c}")) for c in exact},
    }
    missing = F.col("s._stored").isNull() | F.col("f._fresh").isNull()
    return joined.filter(missing | any_of(list(broken.values()))).select(
        *[F.coalesce(f"s.{k}", f"f.{k}").alias(k) for k in keys],
        F.col("s._stored").isNull().alias("missing_in_store"),
        F.col("f._fresh").isNull().alias("missing_in_fact"),
        F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in broken.items()])).alias("diverging"),
    )


def materialisation_metadata(features: DataFrame, fact: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Per cutoff: stored rows, first and last source month before it."""
    stored = features.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("row_count"))
    months = fact.select("production_month").distinct()
    spans = (
        months.select("production_month", F.explode(cutoff_array(fact, cutoffs)).alias("as_of_date"))
        .groupBy("as_of_date")
        .agg(
            F.min(F.when(F.col("production_month") < F.col("as_of_date"), F.col("production_month"))).alias("source_date_start"),
            F.max(F.when(F.col("production_month") < F.col("as_of_date"), F.col("production_month"))).alias("source_date_end"),
        )
    )
    return spans.join(stored, "as_of_date", "left").select(
        "as_of_date", F.coalesce("row_count", F.lit(0)).alias("row_count"), "source_date_start", "source_date_end"
    )

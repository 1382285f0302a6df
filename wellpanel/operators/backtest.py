"""Backtest one or many cutoffs in one job: distributions, coverage, gates, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellpanel.operators.cutoffs import Cutoffs
from wellpanel.operators.decline import decline_mape, fit_declines
from wellpanel.operators.metrics import (
    KEYS, MIN_HISTORY_MONTHS, QUANTILES, observed_history, score_wells, with_mase,
)
from wellpanel.operators.ordering import exact_quantiles
from wellpanel.session import durable

# --- fixed values -------------------------------------------------------------

MIN_FITTED_SHARE = 0.5
MIN_DEFINED_SHARE = 0.5
GATE_NAMES = ("mase_median", "mae_vs_naive", "mape_vs_arps")

# --- end of fixed values --------------------------------------------------------

DISTRIBUTIONS = ("mase", "model_mae_m3", "naive_mae_m3", "mape_nonzero_pct", "arps_mape_nonzero_pct")
_PAIRED = ("paired_mape", "paired_arps_mape")


@dataclass(frozen=True)
class Thresholds:
    """Gate limits; the defaults are the published ones."""

    mase_median_max: float = 1.0
    naive_mae_ratio_max: float = 1.0
    arps_mape_margin_pp: float = 2.0


@dataclass(frozen=True)
class Backtest:
    """Results of :func:`evaluate`; everything is keyed by ``as_of_date``."""

    wells: DataFrame
    summary: DataFrame
    distributions: DataFrame
    gates: DataFrame
    metrics: DataFrame


def well_table(
    test: DataFrame, series: DataFrame, cutoffs: Cutoffs, *, decline: bool = True, fit: Callable[..., DataFrame] = fit_declines
) -> DataFrame:
    """One row per tested (cutoff, well): eligibility, metrics, decline outcome of ``fit(series, cutoffs, wells)``."""
    history = observed_history(series, cutoffs)
    scores = with_mase(score_wells(test), history)
    eligible = F.coalesce(F.col("months_observed") >= MIN_HISTORY_MONTHS, F.lit(False))
    table = scores.withColumn("eligible", eligible).withColumn(
        "evaluable", F.col("eligible") & (F.col("scored_rows") > 0)
    )
    if not decline:
        return table.select(
            "*",
            F.lit(None).cast("boolean").alias("arps_fitted"),
            F.lit(None).cast("double").alias("arps_mape_nonzero_pct"),
        )
    table = durable(table)
    chosen = table.filter("evaluable").select(*KEYS)
    fits = durable(fit(series, cutoffs, chosen))
    scored = test.filter(F.col("naive_forecast_m3").isNotNull())
    outcome = fits.select(*KEYS).join(decline_mape(scored, fits), KEYS, "left")
    return table.join(outcome.withColumn("_fit", F.lit(True)), KEYS, "left").select(
        table["*"],
        F.when(F.col("evaluable"), F.col("_fit").isNotNull()).alias("arps_fitted"),
        "arps_mape_nonzero_pct",
    )


def coverage(wells: DataFrame) -> DataFrame:
    """Counts and pooled errors per cutoff, from one row per well."""
    on = F.col("evaluable")

    def pooled(column: str) -> Column:
        return F.sum(F.when(on, F.col(column))) / F.sum(F.when(on, F.col("scored_rows")))

    return wells.groupBy("as_of_date").agg(
        F.count(F.lit(1)).alias("wells_in_test"),
        F.count_if(on).alias("wells_eligible"),
        F.count_if(~F.col("eligible")).alias("wells_excluded_short_history"),
        F.count_if(on & F.col("mase").isNull()).alias("wells_mase_undefined"),
        F.count_if(on & F.col("arps_fitted")).alias("arps_fitted_wells"),
        F.count_if(on & ~F.col("arps_fitted")).alias("arps_failed_wells"),
        pooled("abs_error_sum").alias("model_mae_m3"),
        pooled("naive_abs_error_sum").alias("naive_mae_m3"),
    )


def metric_quantiles(wells: DataFrame) -> DataFrame:
    """p50/p75/p90 of every metric and cutoff, over the wells where it is defined.

    All metrics share one sort; undefined metrics simply have no row.
    """
    paired = F.col("mape_nonzero_pct").isNotNull() & F.col("arps_mape_nonzero_pct").isNotNull()
    values = {
        **{m: F.col(m) for m in DISTRIBUTIONS},
        "paired_mape": F.when(paired, F.col("mape_nonzero_pct")),
        "paired_arps_mape": F.when(paired, F.col("arps_mape_nonzero_pct")),
    }
    long = wells.filter("evaluable").select(
        *KEYS,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
        ).alias("m"),
    ).select(*KEYS, "m.metric", "m.value")
    return exact_quantiles(long, ["as_of_date", "metric"], "value", "well_id", QUANTILES)


def summarise(wells: DataFrame, quantiles: DataFrame) -> DataFrame:
    """One row per cutoff with everything the gates read."""
    names = [*DISTRIBUTIONS, *_PAIRED]
    medians = quantiles.groupBy("as_of_date").pivot("metric", names).agg(F.first("p50"))
    renamed = medians.select("as_of_date", *[F.col(n).alias(f"median_{n}") for n in names])
    attempted = F.col("arps_fitted_wells") + F.col("arps_failed_wells")
    degraded = (attempted == 0) | (F.col("arps_fitted_wells") < MIN_FITTED_SHARE * attempted)
    naive = F.col("naive_mae_m3")
    perfect_or_never = F.when(F.col("model_mae_m3") == 0, 0.0).otherwise(F.lit(float("inf")))
    return coverage(wells).join(renamed, "as_of_date", "left").select(
        *coverage(wells).columns,
        degraded.alias("arps_degraded"),
        F.col("median_mase").alias("mase_median"),
        F.when(naive > 0, F.col("model_mae_m3") / naive).when(naive.isNotNull(), perfect_or_never).alias("naive_mae_ratio"),
        F.when(~degraded, F.col("median_paired_mape") - F.col("median_paired_arps_mape")).alias("arps_mape_gap_pp"),
    )


def gate_rows(summary: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Three verdicts per cutoff: two that block, one that only informs."""
    mase, ratio, gap = F.col("mase_median"), F.col("naive_mae_ratio"), F.col("arps_mape_gap_pp")
    t = thresholds
    verdicts = [
        (GATE_NAMES[0], mase, t.mase_median_max, mase < t.mase_median_max, True),
        (GATE_NAMES[1], ratio, t.naive_mae_ratio_max, ratio <= t.naive_mae_ratio_max, True),
        (GATE_NAMES[2], gap, t.arps_mape_margin_pp, gap <= t.arps_mape_margin_pp, False),
    ]
    gates = F.array(
        *[
            F.struct(
                F.lit(name).alias("gate"),
                value.alias("value"),
                F.lit(float(limit)).alias("threshold"),
                passed.alias("passed"),
                F.lit(blocking).alias("blocking"),
            )
            for name, value, limit, passed, blocking in verdicts
        ]
    )
    return summary.select("as_of_date", F.explode(gates).alias("g")).select("as_of_date", "g.*")


def gates_passed(gates: DataFrame) -> DataFrame:
    """Per cutoff: did every blocking gate pass?  An undefined verdict does not."""
    ok = ~F.col("blocking") | F.coalesce("passed", F.lit(False))
    return gates.groupBy("as_of_date").agg(F.bool_and(ok).alias("gates_passed"))


def long_metrics(summary: DataFrame, quantiles: DataFrame, gates: DataFrame) -> DataFrame:
    """Every defined number as (cutoff, metric, value) with the published names."""
    counts = (
        "model_mae_m3", "naive_mae_m3", "wells_in_test", "wells_eligible", "wells_excluded_short_history",
        "wells_mase_undefined", "arps_fitted_wells", "arps_failed_wells", "arps_degraded",
    )
    flat = summary.select("as_of_date", *[F.col(c).cast("double").alias(f"eval_{c}") for c in counts])
    parts = [flat.unpivot("as_of_date", [f"eval_{c}" for c in counts], "metric", "value")]
    shown = quantiles.filter(F.col("metric").isin(*DISTRIBUTIONS))
    parts.append(
        shown.unpivot(["as_of_date", "metric"], list(QUANTILES), "q", "value").select(
            "as_of_date", F.concat_ws("_", F.lit("eval"), "metric", "q").alias("metric"), "value"
        )
    )
    parts.append(
        gates.select(
            "as_of_date",
            "gate",
            F.col("passed").cast("double").alias("passed"),
            "value",
        )
        .unpivot(["as_of_date", "gate"], ["passed", "value"], "part", "number")
        .select("as_of_date", F.concat_ws("_", F.lit("eval_gate"), "gate", "part").alias("metric"), F.col("number").alias("value"))
    )
    parts.append(
        gates_passed(gates).select(
            "as_of_date", F.lit("eval_gates_passed").alias("metric"), F.col("gates_passed").cast("double").alias("value")
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull())


def require_representative(summary: DataFrame) -> None:
    """Raise when a cutoff has nobody to judge, or MASE for too few of them."""
    # one row per evaluated cutoff
    rows = summary.select("as_of_date", "wells_eligible", "wells_mase_undefined").collect()
    if not rows:
        raise ValueError("the test split is empty")
    for row in rows:
        if row.wells_eligible == 0:
            raise ValueError(f"cutoff {row.as_of_date}: no tested well has been observed long enough ({MIN_HISTORY_MONTHS} months)")
        defined = row.wells_eligible - row.wells_mase_undefined
        if defined < MIN_DEFINED_SHARE * row.wells_eligible:
            raise ValueError(f"cutoff {row.as_of_date}: the scaled error exists for {defined} of {row.wells_eligible} wells, too few to judge by")


def evaluate(
    predictions: DataFrame,
    series: DataFrame,
    cutoffs: Cutoffs,
    *,
    thresholds: Thresholds = Thresholds(),
    decline: bool = True,
    fit: Callable[..., DataFrame] = fit_declines,
    strict: bool = True,
) -> Backtest:
    """Backtest supervised rows that carry ``prediction_m3``.

    ``predictions`` holds the test rows of every evaluated cutoff.  ``strict``
    refuses an unrepresentative verdict instead of reporting it.
    """
    wells = durable(well_table(predictions, series, cutoffs, decline=decline, fit=fit))
    quantiles = durable(metric_quantiles(wells))
    summary = durable(summarise(wells, quantiles))
    if strict:
        require_representative(summary)
    gates = gate_rows(summary, thresholds)
    return Backtest(
        wells=wells,
        summary=summary,
        distributions=quantiles.filter(F.col("metric").isin(*DISTRIBUTIONS)),
        gates=gates,
        metrics=long_metrics(summary, quantiles, gates),
    )


def report_rows(result: Backtest, thresholds: Thresholds = Thresholds(), horizons: Iterable[int] = (1, 2, 3)) -> DataFrame:
    """One nested row per cutoff: the report as it is stored, with the horizons that were judged."""
    named = result.distributions.groupBy("as_of_date").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("metric", F.struct(*QUANTILES).alias("q"))))
        ).alias("distributions")
    )
    verdicts = result.gates.groupBy("as_of_date").agg(
        F.sort_array(F.collect_list(F.struct("gate", "value", "threshold", "passed", "blocking"))).alias("gates")
    )
    limits = F.struct(*[F.lit(v).alias(k) for k, v in vars(thresholds).items()])
    return (
        result.summary.join(named, "as_of_date", "left")
        .join(verdicts, "as_of_date", "left")
        .join(gates_passed(result.gates), "as_of_date", "left")
        .withColumn("thresholds", limits)
        .withColumn("horizons", F.array(*[F.lit(h) for h in sorted(set(horizons))]))
    )

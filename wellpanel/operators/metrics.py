"""Backtest metrics per well and per evaluated cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellpanel.operators.cutoffs import Cutoffs, cutoff_array, visible_at, well_months

# --- fixed values -------------------------------------------------------------

MIN_HISTORY_MONTHS = 12
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9}

# --- end of fixed values --------------------------------------------------------

KEYS = ["as_of_date", "well_id"]


def step_differences(series: DataFrame) -> DataFrame:
    """Change from each well's previous observed month; calendar gaps collapse."""
    observed = series.filter(F.col("oil_prod_m3").isNotNull()).select(
        "well_id", "production_month", F.col("oil_prod_m3").cast("double").alias("y")
    )
    return observed.withColumn("step_m3", F.col("y") - F.lag("y").over(well_months()))


def observed_history(series: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Per (cutoff, well): observed months before it and the one-step naive error.

    Running count and running sum of steps travel with each observation, so every
    cutoff reads them off its newest earlier observation: all cutoffs in one pass.
    """
    w = well_months()
    running = step_differences(series).select(
        "well_id",
        "production_month",
        F.row_number().over(w).alias("months_observed"),
        F.sum(F.abs("step_m3")).over(w).alias("_steps"),
        F.lead("production_month").over(w).alias("next_month"),
    )
    seen = visible_at(running, cutoff_array(series, cutoffs), 0, ["months_observed", "_steps"])
    return seen.select(
        *KEYS,
        "months_observed",
        F.when(F.col("months_observed") > 1, F.col("_steps") / (F.col("months_observed") - 1)).alias(
            "insample_naive_mae_m3"
        ),
    )


def eligible_wells(series: DataFrame, cutoffs: Cutoffs, min_months: int = MIN_HISTORY_MONTHS) -> DataFrame:
    """Wells with enough observed months strictly before each cutoff."""
    return observed_history(series, cutoffs).filter(F.col("months_observed") >= min_months).select(*KEYS)


def one_step_naive_mae(series: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Mean absolute step per well; wells with fewer than two observations are absent."""
    return observed_history(series, cutoffs).filter(F.col("insample_naive_mae_m3").isNotNull()).select(
        *KEYS, "insample_naive_mae_m3"
    )


def score_wells(test: DataFrame) -> DataFrame:
    """One row per (cutoff, well) with error sums; a well has at most 12 rows per cutoff.

    Rows without a naive forecast count as tested but are not scored, so model
    and baseline are always judged on the same rows.
    """
    target, guess, naive = F.col("oil_prod_m3_target"), F.col("prediction_m3"), F.col("naive_forecast_m3")
    scored = naive.isNotNull()
    error = F.when(scored, target - guess)
    naive_error = F.when(scored, target - naive)
    return test.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(scored).alias("scored_rows"),
        F.sum(F.abs(error)).alias("abs_error_sum"),
        F.sum(F.abs(naive_error)).alias("naive_abs_error_sum"),
        F.avg(F.abs(error)).alias("model_mae_m3"),
        F.sqrt(F.avg(error * error)).alias("model_rmse_m3"),
        F.avg(F.abs(naive_error)).alias("naive_mae_m3"),
        (F.avg(F.when(target > 0, F.abs(error) / target)) * 100.0).alias("mape_nonzero_pct"),
    )


def with_mase(scores: DataFrame, denominators: DataFrame) -> DataFrame:
    """Scale MAE by the in-sample naive error; NULL where that is missing or zero."""
    scale = F.col("insample_naive_mae_m3")
    return scores.join(denominators, KEYS, "left").withColumn(
        "mase", F.when(scale > 0, F.col("model_mae_m3") / scale)
    )


def per_well_metrics(test: DataFrame, denominators: DataFrame) -> DataFrame:
    """MAE, RMSE, naive MAE, MAPE and MASE of every well with a scored row."""
    scores = score_wells(test).filter(F.col("scored_rows") > 0)
    return with_mase(scores, denominators).select(
        *KEYS, "model_mae_m3", "model_rmse_m3", "naive_mae_m3", "mape_nonzero_pct", "mase"
    )


def pooled_metrics(labelled: DataFrame) -> DataFrame:
    """Errors of model and naive on the same test rows, and the size of each split."""
    test = F.col("split") == "test"
    scored = test & F.col("naive_forecast_m3").isNotNull()
    error = F.when(scored, F.col("oil_prod_m3_target") - F.col("prediction_m3"))
    naive_error = F.when(scored, F.col("oil_prod_m3_target") - F.col("naive_forecast_m3"))
    return labelled.agg(
        F.avg(F.abs(error)).alias("model_mae_m3"),
        F.sqrt(F.avg(error * error)).alias("model_rmse_m3"),
        F.avg(F.abs(naive_error)).alias("naive_mae_m3"),
        F.sqrt(F.avg(naive_error * naive_error)).alias("naive_rmse_m3"),
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_if(test).alias("test_rows"),
    )

"""The retraining chain: stored features -> dataset -> fit -> backtest -> verdict."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellpanel.operators import backtest as B
from wellpanel.operators import metrics as M
from wellpanel.operators import model as MD
from wellpanel.operators import supervised as SV
from wellpanel.operators.quality import require_feature_contract
from wellpanel.session import durable
from wellpanel.sources.tables import training_frames


@dataclass(frozen=True)
class Candidate:
    """A fitted model with everything a promotion looks at."""

    model: MD.Fitted
    pooled: DataFrame
    backtest: B.Backtest
    footprint: DataFrame


def retrain(
    features: DataFrame,
    fact: DataFrame,
    as_of: dt.date | str,
    *,
    horizons: Iterable[int] = (1, 2, 3),
    validation_cutoffs: int = 0,
    purge_overlap: bool = False,
    spec: MD.ModelSpec = MD.ModelSpec(),
    thresholds: B.Thresholds = B.Thresholds(),
) -> Candidate:
    """Train on the cutoffs before ``as_of`` and judge the model on ``as_of`` itself."""
    stored, series = training_frames(features, fact, as_of)
    # stored once: the split reads it for its cutoffs and again for its rows
    dataset = durable(SV.training_dataset(require_feature_contract(stored), series, horizons))
    split = SV.temporal_split(dataset, as_of, validation_cutoffs=validation_cutoffs, purge_overlap=purge_overlap)
    fitted = MD.fit(split.filter("split = 'train'"), spec)
    predicted = durable(MD.predict(fitted, split.filter("split = 'test'")))
    counted = split.filter("split <> 'test'").withColumn("prediction_m3", F.lit(None).cast("double"))
    return Candidate(
        model=fitted,
        pooled=M.pooled_metrics(counted.unionByName(predicted)),
        backtest=B.evaluate(predicted, series, [as_of], thresholds=thresholds),
        footprint=SV.dataset_footprint(split),
    )


def run_record(candidate: Candidate, *, model: str, version: str, run_id: str, registered_at: dt.datetime) -> DataFrame:
    """The candidate as a row of the run history the champion is chosen from."""
    metrics = candidate.backtest.metrics.groupBy("as_of_date").agg(
        # a fixed set of metric names
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    return metrics.join(B.gates_passed(candidate.backtest.gates), "as_of_date").select(
        F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(run_id).alias("run_id"),
        "as_of_date", "metrics", "gates_passed", F.lit(registered_at).alias("registered_at"),
    )

"""Continuous arrival of monthly declarations into the typed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wellpanel.operators.latest import latest_per_key, newest_load_first
from wellpanel.operators.quality import Check, require_passed, run_checks
from wellpanel.operators.typed import typed_production
from wellpanel.schema import PRODUCTION_SCHEMA
from wellpanel.session import durable
from wellpanel.sources.tables import read_periods, replace_periods

_KEYS = ["well_id", "production_month"]
_TIES = [c for c in PRODUCTION_SCHEMA.fieldNames() if c not in (*_KEYS, "dlt_load_id")]


def merge_newest(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows and a batch, the newest load of each (well, month) wins.

    Merging the same batch twice changes nothing, so a retried batch is harmless.
    """
    return latest_per_key(stored.unionByName(batch), _KEYS, newest_load_first("dlt_load_id", _TIES))


def apply_batch(spark: SparkSession, raw: DataFrame, path: str, checks: list[Check]) -> None:
    """Type one batch of raw rows, merge it into the months it touches, check those months, and write them.

    The checks see what would be written, as those of a monthly build do; shares of a few rows that happen to arrive
    together mean nothing.
    """
    batch = durable(typed_production(raw))
    touched = read_periods(spark, path, batch, "production_month")
    if touched is not None:
        batch = durable(merge_newest(touched.select(*PRODUCTION_SCHEMA.fieldNames()), batch))
    require_passed(run_checks(batch, checks, "typed_production"))
    replace_periods(batch, path)


def run_arrivals(
    raw_stream: DataFrame, path: str, checkpoint: str, checks: Callable[[], list[Check]]
) -> None:
    """Drain the stream into ``path``; a failed blocking check stops it before the write."""

    def each(batch: DataFrame, _batch_id: int) -> None:
        apply_batch(batch.sparkSession, batch, path, checks())

    (
        raw_stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

"""Layered Parquet tables: full refresh, replace-by-period, upsert, drift, reports.

Only plain Parquet is assumed, so ``MERGE`` is expressed as an anti-join plus a
union, and is always narrowed to the partitions the batch touches.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.functions.columns import strict
from wellpanel.schema import FEATURE_CONTRACT, MEASURE
from wellpanel.session import STORED, durable

#: One namespace per layer.
LAYERS = ("bronze", "silver", "gold", "features")


def layer_path(root: str, layer: str, table: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}, expected one of {LAYERS}")
    return f"{root.rstrip('/')}/{layer}/{table}"


def read_table(spark: SparkSession, path: str, *, base: str | None = None) -> DataFrame | None:
    """The table with the columns of all its files, or ``None`` while nothing has been written there."""
    reader = spark.read.option("mergeSchema", True)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_periods(spark: SparkSession, path: str, batch: DataFrame, period: str) -> DataFrame | None:
    """The partitions of the table that ``batch`` touches; no other file is opened, not even for its columns."""
    # one name per calendar period of the batch
    names = [r[0] or "__HIVE_DEFAULT_PARTITION__" for r in batch.select(F.col(period).cast("string")).distinct().collect()]
    return read_table(spark, f"{path}/{period}={{{','.join(sorted(names))}}}", base=path) if names else None


def replace_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full refresh. ``df`` must not read from ``path``."""
    writer = df.write.options(**STORED).mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def align_columns(batch: DataFrame, target: DataFrame) -> DataFrame:
    """``batch`` with the target's extra columns as NULL; its own new columns stay."""
    return target.limit(0).unionByName(batch, allowMissingColumns=True)


def replace_periods(batch: DataFrame, path: str, period: str = "production_month") -> None:
    """Every period present in the batch is rewritten whole; the others are untouched.

    The shuffle by period keeps the number of files per partition low; a period
    holding most of the batch is split by AQE's rebalance instead of landing in
    one task.
    """
    (
        batch.hint("rebalance", period)
        .write.options(**STORED)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period)
        .parquet(path)
    )


def merge_by_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` replace rows with the same key; vanished keys stay."""
    kept = target.join(batch.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def upsert_periods(
    spark: SparkSession, batch: DataFrame, path: str, keys: list[str], period: str = "production_month"
) -> None:
    """Upsert by key where the period is a function of the key.

    Only the partitions the batch touches are read and rewritten, so the cost
    follows the batch and not the table.  The merged rows are made durable first
    because the write replaces the files they were read from.
    """
    batch = durable(batch)
    touched = read_periods(spark, path, batch, period)
    if touched is None:
        replace_periods(batch, path, period)
        return
    replace_periods(durable(merge_by_key(touched, batch, [*keys, period])), path, period)


def write_version(df: DataFrame, path: str, version: int) -> str:
    """A new immutable copy below ``path``; readers keep the previous one meanwhile."""
    target = f"{path}/version={version:06d}"
    df.write.options(**STORED).mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version:06d}")


def upsert_dimension(
    spark: SparkSession, batch: DataFrame, path: str, keys: list[str], version: int
) -> DataFrame:
    """SCD1 upsert into version ``version`` from version ``version - 1``."""
    merged = batch if version == 0 else merge_by_key(read_version(spark, path, version - 1), batch, keys)
    return spark.read.parquet(write_version(merged, path, version))


def append_with_drift(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """New columns appear, rows from before them hold NULL."""
    return existing.unionByName(batch, allowMissingColumns=True)


def month_range(df: DataFrame, start: dt.date | str | None, end: dt.date | str | None,
                column: str = "production_month") -> DataFrame:
    """Half-open month range; no bounds, no filter."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end).cast("date"))
    return df


def training_frames(features: DataFrame, fact: DataFrame, cutoff: dt.date | str) -> tuple[DataFrame, DataFrame]:
    """Strictly typed features up to the cutoff and the whole series; empty input raises."""
    typed = features.filter(F.col("as_of_date") <= F.lit(cutoff).cast("date")).select(
        *[strict(name, kind).alias(name) for name, kind in FEATURE_CONTRACT.items()]
    )
    series = fact.select(
        F.col("well_id").cast("string").alias("well_id"),
        F.col("production_month").cast("date").alias("production_month"),
        F.col("oil_prod_m3").cast(MEASURE).alias("oil_prod_m3"),
    )
    if typed.isEmpty():
        raise ValueError(f"no stored features up to {cutoff}")
    if series.isEmpty():
        raise ValueError("the production fact is empty")
    return typed, series


def write_json_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines; a report is one row per evaluated cutoff."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)

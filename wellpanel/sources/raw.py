"""Raw snapshots: delimited text in, all-text tables out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.schema import DATE, FEATURE_CONTRACT, NUMERIC, SPARK_TYPES


def read_raw_csv(spark: SparkSession, path: str | list[str], *, multi_line: bool = True) -> DataFrame:
    """Header row, UTF-8 (a BOM is dropped), every cell kept as text.

    ``multi_line`` accepts line breaks inside quoted cells, at the price of one
    task per file.  Turn it off for a publisher that never emits them and large
    files split across tasks.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def store_raw_production(raw: DataFrame, path: str) -> None:
    """Raw declarations as a table partitioned by their text period, so that a range rebuild reads only its months."""
    raw.hint("rebalance", "anio", "mes").write.mode("overwrite").partitionBy("anio", "mes").parquet(path)


def read_raw_production(spark: SparkSession, path: str, raw: DataFrame) -> DataFrame:
    """The stored declarations with the columns of ``raw``, all text."""
    return spark.read.schema(raw.schema).parquet(path).select(*raw.columns)


def _is_blank_header(name: str, position: int) -> bool:
    return not name.strip() or name == f"_c{position}"


def clean_header(df: DataFrame) -> DataFrame:
    """Trim names, drop unnamed columns, missing cells become the empty string."""
    kept = [
        F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name.strip())
        for position, name in enumerate(df.columns)
        if not _is_blank_header(name, position)
    ]
    return df.select(*kept)


def operational_month(
    run_key: str | None = None, range_end: str | None = None, today: dt.date | None = None
) -> str:
    """Partition tag of a load: its key, else the end of its range, else this month."""
    if run_key:
        return run_key
    if range_end:
        return range_end
    return (today or dt.date.today()).replace(day=1).isoformat()


def tag_load(df: DataFrame, *, source: str, partition_key: str, load_id: str) -> DataFrame:
    """Add where a row came from, which month it was loaded for, and by which load."""
    return df.select(
        "*",
        F.lit(source).alias("_source_name"),
        F.lit(partition_key).alias("_partition_key"),
        F.lit(load_id).alias("_dlt_load_id"),
    )


def ingest_csv(
    spark: SparkSession, path: str, *, source: str, partition_key: str, load_id: str, multi_line: bool = True
) -> DataFrame:
    """Scan, header cleanup and provenance in one step."""
    raw = clean_header(read_raw_csv(spark, path, multi_line=multi_line))
    return tag_load(raw, source=source, partition_key=partition_key, load_id=load_id)


def seed_events(spark: SparkSession) -> DataFrame:
    """The one-row table that proves a fresh environment can load at all (fixed values)."""
    return spark.createDataFrame(
        [(1, "SMOKE-WELL", "2026-06-01", 1.0)],
        "event_id long, well_id string, production_month string, oil_m3 double",
    )


def typed_seed_events(raw: DataFrame, load_id: str) -> DataFrame:
    """Typed projection of :func:`seed_events`."""
    return raw.select(
        F.col("event_id").cast("int").alias("event_id"),
        F.col("well_id").cast("string").alias("well_id"),
        F.col("production_month").cast("date").alias("production_month"),
        F.col("oil_m3").cast("decimal(18,6)").alias("oil_m3"),
        F.lit(load_id).alias("dlt_load_id"),
    )


def read_feature_extract(spark: SparkSession, path: str) -> DataFrame:
    """CSV extract of the feature table: ids stay text, dates and numbers are typed."""
    schema = ", ".join(
        f"{name} {SPARK_TYPES[kind].simpleString()}" for name, kind in FEATURE_CONTRACT.items()
    )
    return spark.read.csv(path, schema=schema, header=True, dateFormat="yyyy-MM-dd", mode="FAILFAST")


def read_series_extract(spark: SparkSession, path: str) -> DataFrame:
    """CSV extract of the monthly series."""
    schema = (
        f"well_id string, production_month {SPARK_TYPES[DATE].simpleString()}, "
        f"oil_prod_m3 {SPARK_TYPES[NUMERIC].simpleString()}"
    )
    return spark.read.csv(path, schema=schema, header=True, dateFormat="yyyy-MM-dd", mode="FAILFAST")

"""Request-log metrics in tumbling and sliding windows.

Each function takes a log (``ts``, ``handler``, ``status``, ``latency``,
``is_error``) and works on a batch table or on a stream with a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.operators.ordering import exact_quantiles
from wellpanel.session import durable
from wellpanel.sources import published as PB
from wellpanel.sources.tables import upsert_periods

# --- fixed values -------------------------------------------------------------

WATERMARK = "10 minutes"
LATENCY_BOUNDS = (0.1, 0.5, 1.0)
LATENCY_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
ALERT_THRESHOLD = 80.0
ALERT_POINTS = 5

# --- end of fixed values --------------------------------------------------------


def _bounds() -> list[Column]:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def request_rate(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests per second and handler in tumbling windows."""
    return log.groupBy(F.window("ts", f"{seconds} seconds"), "handler").agg(
        F.count(F.lit(1)).alias("requests")
    ).select(*_bounds(), "handler", "requests", (F.col("requests") / F.lit(float(seconds))).alias("rate_per_second"))


def error_share(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Failed requests as a percentage, in tumbling windows."""
    return log.groupBy(F.window("ts", f"{seconds} seconds")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors")
    ).select(*_bounds(), "requests", "errors", (F.col("errors") * 100.0 / F.col("requests")).alias("error_pct"))


def trailing_requests(log: DataFrame, by_status: bool, length: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    """Requests of the trailing half hour, per status or in total."""
    keys = ["status"] if by_status else []
    return log.groupBy(F.window("ts", length, slide), *keys).agg(
        F.count(F.lit(1)).alias("requests")
    ).select(*_bounds(), *keys, "requests")


def mean_latency(log: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Mean latency of the trailing minutes."""
    return log.groupBy(F.window("ts", length, slide)).agg(
        F.avg("latency").alias("mean_latency"), F.count(F.lit(1)).alias("requests")
    ).select(*_bounds(), "mean_latency", "requests")


def latency_percentiles(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Exact percentiles per handler and tumbling window, from the raw values (batch only)."""
    placed = log.select(
        F.window("ts", f"{seconds} seconds")["start"].alias("window_start"), "handler", "latency", "request_id"
    )
    return exact_quantiles(placed, ["window_start", "handler"], "latency", "request_id", LATENCY_QUANTILES)


def streamed_percentiles(log: DataFrame, seconds: int = 60) -> DataFrame:
    """The same exact percentiles where a stream is wanted; state holds the distinct values of open windows."""
    return log.groupBy(F.window("ts", f"{seconds} seconds"), "handler").agg(
        *[F.percentile("latency", q).alias(name) for name, q in LATENCY_QUANTILES.items()]
    ).select(F.col("window.start").alias("window_start"), "handler", *LATENCY_QUANTILES)


def handler_latency(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Mean latency per handler in tumbling windows, the points an alert looks at."""
    return log.groupBy(F.window("ts", f"{seconds} seconds"), "handler").agg(F.avg("latency").alias("mean_latency")).select(
        *_bounds(), "handler", "mean_latency"
    )


def latency_histogram(log: DataFrame, bounds: tuple[float, ...] = LATENCY_BOUNDS, seconds: int = 60) -> DataFrame:
    """Percentiles interpolated from cumulative bucket counts.

    State is one counter per bucket whatever the traffic, which is what lets a
    stream keep it; values above the last bound read as that bound.
    """
    buckets = [F.count_if(F.col("latency") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    counts = log.groupBy(F.window("ts", f"{seconds} seconds"), "handler").agg(
        F.count(F.lit(1)).alias("requests"), *buckets
    )
    return counts.select(
        *_bounds(),
        "handler",
        "requests",
        *[bucket_quantile(q, bounds).alias(name) for name, q in LATENCY_QUANTILES.items()],
    )


def bucket_quantile(q: float, bounds: tuple[float, ...]) -> Column:
    """Linear interpolation inside the first bucket whose cumulative count reaches the rank."""
    rank = F.col("requests") * F.lit(q)
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = float(bounds[i - 1]) if i else 0.0
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        inside = F.col(f"le_{i}") - below
        share = (rank - below) / F.nullif(inside, F.lit(0))
        value = F.lit(low) + (float(bounds[i]) - low) * share
        out = F.when(F.col(f"le_{i}") >= rank, value).otherwise(out)
    return out


def sustained_alert(points: DataFrame, value: str, keys: list[str], *, threshold: float = ALERT_THRESHOLD,
                    held: int = ALERT_POINTS, step_seconds: int = 60) -> DataFrame:
    """Windows at which ``value`` has exceeded the threshold ``held`` times in a row.

    Each breach votes for the windows it can help to fire; a window with all
    ``held`` votes fires.  One hash aggregation, so a key with a third of all
    windows is spread like any other.
    """
    votes = points.filter(F.col(value) > threshold).select(
        *keys,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(held - 1)),
                lambda i: F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i * step_seconds),
            )
        ).alias("firing_at"),
    )
    return votes.groupBy(*keys, "firing_at").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == held).drop("_n")


def decide_alerts(batch: DataFrame, batch_id: int, path: str, value: str, keys: list[str], *, threshold: float, held: int, step_seconds: int) -> DataFrame:
    """Put the changed windows of a micro-batch into ``<path>/metrics`` and decide again what they can have changed.

    A window takes part in its own verdict and in those of the next ``held - 1`` windows, nothing else; so only these
    are decided, from the days they look back on.  ``<path>/alerts`` keeps the verdict of every window that was ever
    asked, and the verdict before the batch; ``<path>/events`` gets one row for each that changed.  Returns the verdicts
    of the batch.  A batch that runs twice leaves the same tables: its rows remember the verdict before it.
    """
    spark = batch.sparkSession
    steps = F.transform(F.sequence(F.lit(0), F.lit(held - 1)), lambda i: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i * step_seconds))
    batch = durable(batch.withColumn("window_day", F.to_date("window_start")))
    PB.upsert_periods(spark, batch, f"{path}/metrics", ["window_start", *keys], "window_day")
    asked = durable(
        batch.select(*keys, F.explode(F.transform(steps, lambda s: F.col("window_start") + s)).alias("firing_at")).distinct()
        .withColumn("firing_day", F.to_date("firing_at"))
    )

    def days(column: Column) -> set[str]:
        """Calendar days of the batch's windows."""
        return {str(r[0]) for r in asked.select(F.explode(column).alias("day")).distinct().collect()}

    behind = days(F.transform(steps, lambda s: F.to_date(F.col("firing_at") - s)))
    points = PB.read(spark, PB.current(spark, f"{path}/metrics", "window_day"), behind)
    fired = sustained_alert(points, value, keys, threshold=threshold, held=held, step_seconds=step_seconds).withColumn("firing", F.lit(True))
    stored = PB.read(spark, PB.current(spark, f"{path}/alerts", "firing_day"), days(F.array("firing_day")))
    at = ["firing_at", *keys]
    if stored is None:
        before = asked.limit(0).select(*at, F.lit(False).alias("before"))
    else:
        before = stored.select(*at, F.when(F.col("batch_id") == batch_id, F.col("was_firing")).otherwise(F.col("firing")).alias("before"))
    decided = durable(
        asked.join(fired, at, "left").join(before, at, "left").select(
            *at, "firing_day", F.coalesce("firing", F.lit(False)).alias("firing"), F.coalesce("before", F.lit(False)).alias("was_firing"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        )
    )
    PB.upsert_periods(spark, decided, f"{path}/alerts", at, "firing_day")
    changed = decided.filter("firing <> was_firing").select(*at, F.when(F.col("firing"), "firing").otherwise("resolved").alias("event"))
    changed.write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id:09d}")
    for table in ("metrics", "alerts"):
        PB.expire(spark, f"{path}/{table}")
    return decided


def run_alert(metrics: DataFrame, value: str, keys: list[str], path: str, checkpoint: str, *, threshold: float = ALERT_THRESHOLD,
              held: int = ALERT_POINTS, step_seconds: int = 60) -> None:
    """Process what has arrived of the windowed ``metrics``; alerts fire and resolve micro-batch by micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            decide_alerts(batch, batch_id, path, value, keys, threshold=threshold, held=held, step_seconds=step_seconds)

    (
        metrics.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def current_alerts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The windows that fire by all that has arrived."""
    rows = PB.read_current(spark, f"{path}/alerts", "firing_day")
    if rows is None:
        return spark.createDataFrame([], f"{', '.join(k + ' string' for k in keys)}, firing_at timestamp")
    return rows.filter("firing").select(*keys, "firing_at")


def watermarked(log: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return log.withWatermark("ts", delay)


def run_to_table(metrics: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Process what has arrived and replace the touched windows in the table at ``path``, then stop.

    Update mode hands over every window that changed, open or closed, so the table always shows all that has arrived;
    the watermark only bounds the state.  The table is partitioned by day: a micro-batch reads and rewrites the days
    of its windows.  Replacing the same windows twice changes nothing, so a retried batch is harmless.
    """

    def each(batch: DataFrame, _batch_id: int) -> None:
        days = batch.withColumn("window_day", F.to_date("window_start"))
        upsert_periods(batch.sparkSession, days, path, ["window_start", *keys], "window_day")

    (
        metrics.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

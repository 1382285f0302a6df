"""Global order without a single-task window: positions, ranks, exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellpanel.session import durable

_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in a total order.

    A distributed sort puts ascending ranges into ascending partitions, and
    ``monotonically_increasing_id`` then encodes (partition, row in partition).
    The sorted rows are made durable so that both halves of the plan see one and
    the same partitioning; only one count per partition is summed up centrally.
    ``order`` must end in a unique column, which also splits runs of equal values
    over several partitions.
    """
    placed = durable(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per sort partition: bounded by the shuffle width, not by the data
    starts = sizes.select(
        "_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit(_ROW_MASK)))
        .drop("_part", "_start", "_id")
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based rank of every row; ``order`` must be total."""
    return with_position(df, order, "_position").withColumn(name, F.col("_position") + 1).drop("_position")


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, tie: str, quantiles: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, NULL values ignored.

    Same numbers as the exact ``percentile`` aggregate, but no task ever holds
    the distinct values of a whole group: values are sorted once over all groups
    and only the two neighbours of each wanted position are kept.
    """
    defined = df.filter(F.col(value).isNotNull()).select(*groups, value, tie)
    placed = with_position(defined, [F.asc(c) for c in (*groups, value, tie)])
    sizes = placed.groupBy(*groups).agg(
        F.min("position").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    wanted = sizes.select(
        *groups,
        "_first",
        "_n",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()])
        ).alias("_w"),
    ).select(
        *groups,
        F.col("_w.label").alias("_label"),
        ((F.col("_n") - 1) * F.col("_w.q")).alias("_at"),
        "_first",
    )
    neighbours = wanted.select(
        *groups,
        "_label",
        (F.col("_at") - F.floor("_at")).alias("_weight"),
        F.explode(
            F.array_distinct(
                F.array(F.col("_first") + F.floor("_at"), F.col("_first") + F.ceil("_at"))
            )
        ).alias("position"),
        (F.col("_first") + F.floor("_at")).alias("_low"),
    )
    # positions are unique over all groups, so the position alone is the join key
    hits = neighbours.join(placed.select("position", F.col(value).alias("_value")), "position")
    low = F.max(F.when(F.col("position") == F.col("_low"), F.col("_value")))
    high = F.coalesce(F.max(F.when(F.col("position") != F.col("_low"), F.col("_value"))), low)
    weight = F.max("_weight")
    return (
        hits.groupBy(*groups)
        .pivot("_label", list(quantiles))
        .agg((low + (high - low) * weight).alias("q"))
    )

"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions.  Targets are proportional to the sources' weights, clamped at ``epochs`` times a
source's size; each round hands the excess to the sources that are not clamped, until none is above.  A source
with target t and size s is repeated floor(t / s) times, and once more for the documents that come first in a
seeded order, as long as the middle of a document lies within the remaining words.  So a source misses its
target by at most half of one document.

The seeded order is that of a hash.  The point where a source's remaining words end is found by descent: word
sums by the next two digits of the hash, at most 256 a source and level, then the documents of one narrow
bucket.  No task sorts a source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellpanel.llm.storage import staged, table, whole_row
from wellpanel.operators.ordering import global_rank

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = Fraction(3, 2), 2
#: Documents left in the bucket that is at last put in order.
BUCKET_ROWS = 500


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Place in the seeded order; a document without an id is placed by its text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))))


def water_fill(sources: DataFrame, share: Fraction, epochs: int) -> DataFrame:
    """Adds ``target`` to a stored table of (source, source_size, weight)."""
    size, weight = F.col("source_size"), F.col("weight")
    total = sources.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    level, seen = 0.0, None
    while True:
        clamped = (weight * F.lit(level) > size * epochs) if seen else F.lit(False)
        full, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(clamped, size)), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0))
        ).first()
        if (full, open_weight) == seen:
            break
        seen = (full, open_weight)
        left = total * share - full * epochs
        level = float(left.numerator) / float(left.denominator * open_weight) if open_weight else float("inf")
    most = (size * epochs).cast("double")
    return sources.withColumn("target", most if level == float("inf") else F.least(weight * F.lit(level), most))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["of_source"])


def cuts(sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """(of_source, whole, cut): whole repetitions and the last order key that is taken once more."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    state = targets.select(
        F.col("source").alias("of_source"), whole.alias("whole"), (target - whole * size).alias("want"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before")
    )
    levels = 1
    while rows > BUCKET_ROWS * 256**levels:
        levels += 1
    by_source = Window.partitionBy("of_source")
    for level in range(levels):
        digits = F.substring("key", 1, 2 * level + 2)
        inside = sized.join(state, _same_source(sized, state)).filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy("of_source", digits.alias("next")).agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("whole", "want", "before")])
        placed = sums.withColumn("start", F.col("before") + F.sum("words").over(by_source.orderBy("next")) - F.col("words"))
        held = placed.filter(F.col("start") <= F.col("want")).groupBy("of_source").agg(F.max("next").alias("prefix"), F.max_by("start", "next").alias("before"))
        state = staged(
            state.select("of_source", "whole", "want").join(held.withColumnRenamed("of_source", "held"), F.col("of_source").eqNullSafe(F.col("held"))).drop("held"), "cut"
        )
    inside = sized.join(state, _same_source(sized, state)).filter(F.col("key").startswith(F.col("prefix")))
    ties = inside.groupBy("of_source", "key").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("want", "before")])
    start = F.col("before") + F.sum("words").over(by_source.orderBy("key")) - F.col("words")
    taken = ties.withColumn("start", start).filter(2 * F.col("start") + F.col("words") <= 2 * F.col("want"))
    last = taken.groupBy(F.col("of_source").alias("held")).agg(F.max("key").alias("last"))
    return state.join(last, F.col("of_source").eqNullSafe(F.col("held")), "left").select("of_source", "whole", F.coalesce("last", "prefix").alias("cut"))


def plan(sized: DataFrame, share: Fraction = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(of_source, source_size, target, whole, cut) from a stored table of (source, size, key)."""
    sums = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    place = F.col("place") - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = staged(global_rank(sums, [F.asc_nulls_last("source")], "place").select("source", "source_size", weight.alias("weight")), "weights")
    targets = staged(water_fill(ranked, share, epochs), "targets")
    rows = sums.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    found = cuts(sized, targets, rows).withColumnRenamed("of_source", "held")
    return staged(
        targets.join(found, F.col("source").eqNullSafe(F.col("held"))).select(F.col("source").alias("of_source"), "source_size", "target", "whole", "cut"), "plan"
    )


def _times() -> Column:
    return F.col("whole") + (F.col("key") <= F.col("cut")).cast("int")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    A null text has size 0, a null source is a source of its own and comes last, a source without words has target
    0 and nothing of it is taken.  Rows that repeat an id share one place in the seeded order, so they are taken
    alike.  The same rows and seed give the same result.  An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    sized = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
            order_key(F.col("doc_id"), text, seed).alias("key"),
        ),
        "sized",
    )
    by_source = plan(sized.select("source", "size", "key"))
    return sized.join(by_source, _same_source(sized, by_source)).select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def repeat_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names."""
    text = F.col("text").cast("string")
    key = order_key(F.col("doc_id"), text, seed)
    sized = staged(docs.select(F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("key")), "sized")
    by_source = plan(sized).select("of_source", "whole", "cut")
    rows = docs.select(whole_row(docs), F.col("source").cast("string").alias("source"), key.alias("key"))
    times = F.col("whole") + (F.col("key") <= F.col("cut")).cast("int")
    taken = rows.join(by_source, rows["source"].eqNullSafe(by_source["of_source"])).select("row", times.alias("times")).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, (SELECT 3 * sum(source_size) FROM s) - 4 * (sum(source_size) OVER w - source_size) AS left2,
    (SELECT sum(weight) FROM s) - (sum(weight) OVER w - weight) AS open_weight, row_number() OVER w AS k
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(min_by(left2::DOUBLE / (2 * open_weight)::DOUBLE, k), 'inf'::DOUBLE) AS level FROM o WHERE weight * (left2::DOUBLE / (2 * open_weight)::DOUBLE) <= 2 * source_size),
t AS (SELECT source, source_size, least(weight * level, (2 * source_size)::DOUBLE) AS target FROM s, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS want,
    sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS tied
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * (upto - tied) + tied <= 2 * want THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

"""Quality of texts: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Features are the one- and two-word grams of a text and of its word shapes (case and letter runs reduced, so
that an unseen word still shows its form), hashed into ``BUCKETS``.  A text with n features gives each
occurrence the value 1 / sqrt(n), so long texts do not saturate.  Scoring is a sparse dot product.

Training reads about ``TRAINING_ROWS`` labelled rows, chosen by a hash of their id: one FTRL learner goes
over that bounded sample ``EPOCHS`` times.  Only the weights (BUCKETS floats) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import fold, hash_sample, table
from wellpanel.llm.words import mix64, row_groups, span_hashes, text_bytes, word_spans

BUCKETS = 1 << 18
TRAINING_ROWS = 8192
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.3
FOLDS = 5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("b")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


def _shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with each run of one character class written once."""
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return span_hashes(shape[keep], at[starts], at[ends])


def _grams(words: np.ndarray, row: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    ones = mix64(words ^ np.uint64(salt))
    follows = row[1:] == row[:-1]
    twos = mix64(ones[:-1] * np.uint64(3) + words[1:])[follows]
    return np.concatenate((ones, twos)), np.concatenate((row, row[:-1][follows]))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, feature of each occurrence, its row, occurrences by row) for groups of rows."""
    data, offsets = text_bytes(column)
    for first, last in row_groups(offsets):
        part = offsets[first : last + 1] - offsets[first]
        view = data[offsets[first] : offsets[last]]
        starts, ends = word_spans(view, part)
        row = np.searchsorted(part, starts, side="right") - 1
        plain, a = _grams(span_hashes(view, starts, ends), row, 0x51ED)
        shape, b = _grams(_shape_hashes(view, starts, ends), row, 0x7A3B)
        found, rows = np.concatenate((plain, shape)), np.concatenate((a, b))
        index = (found >> np.uint64(64 - 18)).astype(np.int64)
        yield first, last, index, rows, np.bincount(rows, minlength=last - first)


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features and their values, for the bounded training sample."""
    for batch in batches:
        for first, last, index, rows, counts in features(batch.column("text")):
            order = np.argsort(rows, kind="stable")
            bounds = np.concatenate(([0], np.cumsum(counts)))
            ids, values = [], []
            for r in range(last - first):
                own, times = np.unique(index[order[bounds[r] : bounds[r + 1]]], return_counts=True)
                ids.append(own.astype(np.int32).tobytes())
                values.append((times / np.sqrt(max(1, counts[r]))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("turn").slice(first, last - first),
                    batch.column("label").slice(first, last - first),
                    pa.array(ids, pa.binary()),
                    pa.array(values, pa.binary()),
                ],
                names=["turn", "label", "ids", "vals"],
            )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` FTRL-proximal passes; the last entry is the bias."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for _ in range(epochs):
        for ids, values, label in rows:
            own = np.append(ids, buckets)
            x = np.append(values, 1.0)
            w = _weights(z[own], n[own])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA
            z[own] += g - sigma * w
            n[own] += g * g
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train(sample: pd.DataFrame) -> pd.DataFrame:
    rows = [
        (np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float), int(y))
        for i, v, y in sample.sort_values(["turn", "ids"])[["ids", "vals", "label"]].itertuples(index=False)
    ]
    return pd.DataFrame({"weights": [ftrl(rows).astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights learned from about ``rows`` labelled documents outside the held-out fold.

    A document labelled more than once counts with its largest label; without labelled rows all weights are 0,
    so every score is 0.5.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .filter(fold(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    sample = hash_sample(known, "doc_id", rows, 11).select("doc_id", "label", F.xxhash64("doc_id", F.lit(29)).alias("turn"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (
        texts.join(F.broadcast(sample), "doc_id")  # fewer than 2 * rows narrow rows
        .select("turn", "label", "text")
        .mapInArrow(_sparse_rows, "turn long, label int, ids binary, vals binary")
        .limit(3 * rows)  # ids that repeat in the documents do not lift the bound
        .groupBy(F.lit(0).alias("one"))
        .applyInPandas(_train, "weights binary")
        .first()
    )
    return np.frombuffer(found["weights"], np.float32) if found else np.zeros(BUCKETS + 1, np.float32)


def probabilities(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Of label 1, for a column of texts."""
    dots = np.zeros(len(column))
    for first, last, index, rows, counts in features(column):
        dots[first:last] = np.bincount(rows, weights[index], last - first) / np.sqrt(np.maximum(counts, 1))
    return 1 / (1 + np.exp(-np.clip(dots + weights[-1], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, columns: list[str], text: str = "text") -> DataFrame:
    """``docs.select(columns)`` and ``score``; ``text`` is the column to read and need not be among them."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(probabilities(column, w))], names=[*kept.schema.names, "__score__"])

    narrow = docs.select(*columns, F.col(text).cast("string").alias("__text__"))
    schema = narrow.drop("__text__").schema.add("__score__", "double")
    return narrow.mapInArrow(scored, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Scores depend on the text alone: null and empty texts get the bias, equal texts equal scores, whole texts
    are read.  A null id keeps its row.  Repeated rows are scored each.  Empty tables give empty results.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("__score__").alias("score"),
        (F.col("__score__") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns, whatever their names.

    Only the text goes to Python and only its score comes back; the other columns stay in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels).astype(np.float64))

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(probabilities(texts, shared.value))

    return docs.filter(probability(F.col("text").cast("string")) >= threshold)


def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

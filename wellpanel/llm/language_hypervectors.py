"""Language identification with hyperdimensional profiles of letter trigrams.

Every symbol has a random vector of +1 and -1 in ``DIMENSIONS`` dimensions.  A trigram is bound as
``shift2(first) * shift1(second) * third``; a text, and a language, is the bundle (sum) of its trigrams.
A document gets the language whose prototype has the largest cosine with its bundle.

The dot product of a bundle with a prototype is the sum of its trigrams' dot products with it, so these are
tabulated once per trigram (``SYMBOLS ** 3`` numbers a language, a fixed size) and a text is scored by table
look-ups.  The length of the document's own bundle divides all its cosines alike; it changes neither the order
nor the reported ratio and is left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import fold, table
from wellpanel.llm.words import row_groups, text_bytes

DIMENSIONS = 2048
SYMBOLS = 64
CODES = SYMBOLS**3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, 1..26 for a..z, the rest shared by other letters."""
    if not _TABLE:
        found = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = ord(chr(c).lower()[0])
                found[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 0x9E3779B1 >> 7) % (SYMBOLS - 27)
        _TABLE.append(found)
    return _TABLE[0]


def vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed random vectors of all symbols."""
    return np.random.default_rng(271828).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, trigram codes, row of each, letters by row) for groups of rows.

    Runs of other characters count as one gap, and each text starts and ends with one.
    """
    of = symbols()
    data, offsets = text_bytes(column)
    for first, last in row_groups(offsets):
        # code points: every byte that does not continue a UTF-8 sequence starts one
        text = data[offsets[first] : offsets[last]].tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        view = data[offsets[first] : offsets[last]]
        heads = np.concatenate(([0], np.cumsum((view & 0xC0) != 0x80)))
        if heads[-1] != len(points):  # malformed bytes: decode row by row
            rows = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in range(first, last)]
            points = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        else:
            bounds = heads[offsets[first : last + 1] - offsets[first]]
        n = last - first
        symbol = np.zeros(len(points) + 2 * n, np.uint8)
        row = np.repeat(np.arange(n), np.diff(bounds) + 2)
        symbol[np.arange(len(points)) + 2 * row_of(bounds) + 1] = of[points]
        keep = np.ones(len(symbol), bool)
        keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (row[1:] != row[:-1])
        symbol, row = symbol[keep].astype(np.int32), row[keep]
        code = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
        whole = row[:-2] == row[2:]
        yield first, last, code[whole], row[:-2][whole], np.bincount(row[symbol > 0], minlength=n)


def row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language over the task's rows; the languages of a task share one table of fixed width."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        place = np.array([names.index(x) for x in langs], np.int64)
        for first, last, code, row, _ in trigrams(batch.column("text")):
            got = np.bincount(code + place[first:last][row] * CODES, minlength=len(names) * CODES)
            for k, name in enumerate(names):
                part = got[k * CODES : (k + 1) * CODES]
                if name in counts:
                    counts[name] += part
                elif part.any():
                    counts[name] = part.astype(np.int64)
    for name, got in counts.items():
        code = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(code)), pa.array(code.astype(np.int32)), pa.array(got[code])], names=["lang", "code", "n"]
        )


def bind(codes: np.ndarray, symbol_vectors: np.ndarray) -> np.ndarray:
    """The vectors of trigram codes."""
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(symbol_vectors, 2, axis=1)[a] * np.roll(symbol_vectors, 1, axis=1)[b] * symbol_vectors[c]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Learned languages and the table of trigram scores, one row a language.

    Trigrams are counted over every text outside the held-out fold whose language is known.  What reaches the
    driver is at most CODES counts a language.
    """
    counted = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .filter("text is not null and lang is not null")
        .filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .select("lang", "text")
        .mapInArrow(_count, "lang string, code int, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    lang = np.array(counted["lang"].to_pylist(), object)
    code, n = counted["code"].to_numpy(), counted["n"].to_numpy()
    names = sorted(set(lang))
    base = vectors()
    prototypes = np.zeros((len(names), DIMENSIONS), np.float64)
    for k, name in enumerate(names):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(code[own])]
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            prototypes[k] += n[part].astype(np.float64) @ bind(code[part], base).astype(np.float64)
    return names, trigram_scores(prototypes, base)


def trigram_scores(prototypes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Dot products of every trigram's vector with each prototype, divided by the prototype's length."""
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(length > 0, length, 1)).astype(np.float32)
    scores = np.zeros((len(prototypes), CODES), np.float32)
    for at in range(0, CODES if len(prototypes) else 0, 4096):
        scores[:, at : at + 4096] = unit @ bind(np.arange(at, at + 4096), base).T
    return scores


def best_language(column: pa.Array, names: list[str], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a column of texts: place of the best language, whether it counts, and best over best plus second."""
    size = len(column)
    dots, letters = np.zeros((max(1, len(names)), size)), np.zeros(size, np.int64)
    for first, last, code, row, found in trigrams(column):
        letters[first:last] = found
        for k in range(len(names)):
            dots[k, first:last] = np.bincount(row, scores[k][code], last - first)
    ranked = np.maximum(np.sort(dots, axis=0), 0)
    top, second = ranked[-1], ranked[-2] if len(ranked) > 1 else np.zeros(size)
    sure = np.divide(top, top + second, out=np.zeros(size), where=top > 0)
    return dots.argmax(axis=0), (letters > 0) & bool(names), sure


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str]) -> DataFrame:
    """``docs.select(columns)``, ``__lang__`` and ``__sure__`` (best over best plus second, by cosine)."""
    names, scores = model
    shared = docs.sparkSession.sparkContext.broadcast((names, scores))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scores = shared.value
        for batch in batches:
            best, known, sure = best_language(batch.column(batch.num_columns - 1), names, scores)
            label = pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], label, pa.array(np.where(known, sure, 0.0))],
                names=[*batch.schema.names[:-1], "__lang__", "__sure__"],
            )

    narrow = docs.select(*columns, F.col("text").cast("string").alias("__text__"))
    return narrow.mapInArrow(predict, narrow.drop("__text__").schema.add("__lang__", "string").add("__sure__", "double"))


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``.

    Null texts and texts without letters are ``und`` with score 0, as is everything when no language was learned.
    The score is best / (best + second best) over the cosines, negative ones counted as 0.  Only the text decides,
    read whole; equal texts get equal answers, a null id keeps its row, and ties go to the language that sorts first.
    """
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs), ["doc_id"])
    return found.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("__lang__").alias("lang_pred"), F.col("__sure__").alias("score")
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in a learned language, with all their columns, whatever their names; texts
    without letters go.  Only the text goes to Python; the other columns stay in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        return pa.array(best_language(texts, *shared.value)[1])

    return docs.filter(known(F.col("text").cast("string")))


def op9_language_hypervectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))

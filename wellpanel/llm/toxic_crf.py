"""Toxic spans by a linear-chain conditional random field with two states, clean and toxic.

Documents carry labels, words do not; words get them from a lexicon learned by greedy cover: the word or stem that
marks the most still unexplained toxic texts, and hardly any other, is taken until none is left.  Its words in
toxic texts are labelled toxic, all others clean, and the field is trained on these sequences.  Forward-backward
marginals score every word; a document's score is its largest marginal, and its offending spans are the words at or
above one half.

Both directions are prefix products of 2 x 2 matrices over all words of a group of texts; a text's first word
carries a matrix that forgets what came before.  So whole texts of any length are read without a loop per word.
Training reads about ``TRAINING_ROWS`` labelled texts of each class, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellpanel.llm.storage import fold, hash_sample, table
from wellpanel.llm.words import mix64, row_groups, span_hasher, span_hashes, text_bytes, word_spans

BUCKETS = 1 << 18
TRAINING_ROWS = 2048
FOLDS = 5
THRESHOLD = 0.5
#: A word of the lexicon marks at least so many distinct texts, and is so many times as frequent among toxic ones.
LEAST_TEXTS, LEAST_ODDS = 5, 20
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.5, 1e-5
LANE = 64
#: Bytes of a word's stems, and the number of features of a word.
STEMS = (4, 5, 6, 7)
WIDTH = 2 + len(STEMS)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features a word: as written, its letters and digits, and their first bytes (stems of related words)."""
    keep = _LETTER[view]
    at = np.concatenate(([0], np.cumsum(keep)))
    first, last = at[starts], at[ends]
    core = span_hasher(view[keep])
    stems = [mix64(core(first, np.minimum(first + k, last)) ^ np.uint64(k)) for k in STEMS]
    return np.stack((span_hashes(view, starts, ends) ^ np.uint64(0x9E37), core(first, last), *stems), axis=1)


def prefix_products(m: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, each scaled to a sum of one."""
    n = len(m)
    if n <= LANE:
        out = m / m.sum(axis=(1, 2), keepdims=True)
        for k in range(1, n):
            step = out[k - 1] @ out[k]
            out[k] = step / step.sum()
        return out
    lanes = -(-n // LANE)
    padded = np.broadcast_to(np.eye(2), (lanes * LANE, 2, 2)).copy()
    padded[:n] = m
    block = padded.reshape(lanes, LANE, 2, 2).transpose(1, 2, 3, 0).copy()
    block /= block.sum(axis=(1, 2), keepdims=True)
    for k in range(1, LANE):
        a, b = block[k - 1], block[k].copy()
        for i in range(2):
            for j in range(2):
                block[k, i, j] = a[i, 0] * b[0, j] + a[i, 1] * b[1, j]
        block[k] /= block[k].sum(axis=(0, 1))
    before = prefix_products(block[-1].transpose(2, 0, 1))[:-1].transpose(1, 2, 0)
    for k in range(LANE):
        own = block[k, :, :, 1:].copy()
        for i in range(2):
            for j in range(2):
                block[k, i, j, 1:] = before[i, 0] * own[0, j] + before[i, 1] * own[1, j]
    block /= block.sum(axis=(1, 2), keepdims=True)
    return block.transpose(3, 0, 1, 2).reshape(-1, 2, 2)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word, and expected transitions; ``first`` marks the first word of each text.

    ``transitions[i, j]`` is the log weight of moving from i to j; row 2 holds the weights of starting.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((3, 2))
    e = np.stack((np.ones(n), np.exp(np.clip(emission, -30, 30))), axis=1)
    w = np.exp(transitions)
    m = w[None, :2, :] * e[:, None, :]
    m[first] = (w[2][None, :] * e[first])[:, None, :]
    alpha = prefix_products(m)[:, 0, :]
    after = np.empty_like(m)
    after[:-1] = m[1:]
    after[np.append(first[1:], True)] = 0.5
    beta = prefix_products(after[::-1].transpose(0, 2, 1))[::-1, 0, :]
    joint = alpha * beta
    total = joint.sum(axis=1)
    p = joint[:, 1] / total
    expected = np.zeros((3, 2))
    expected[2] = (joint[first] / total[first, None]).sum(axis=0)
    inner = np.flatnonzero(~first)
    if len(inner):
        pair = alpha[inner - 1][:, :, None] * m[inner] * beta[inner][:, None, :]
        expected[:2] = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, expected


def learn_lexicon(cores: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Words and stems that explain the toxic texts, by greedy cover; texts are given as their distinct ones."""
    n = np.array([max(1, (~toxic).sum()), max(1, toxic.sum())])
    words, at = np.unique(np.concatenate([*cores, np.zeros(0, np.uint64)]), return_inverse=True)
    doc = np.repeat(np.arange(len(cores)), [len(c) for c in cores])
    clean = np.bincount(at[~toxic[doc]], minlength=len(words))
    open_doc = toxic.copy()
    found = []
    while len(words):
        marked = np.bincount(at[open_doc[doc]], minlength=len(words))
        fit = (marked >= LEAST_TEXTS) & ((marked + 0.5) / n[1] >= LEAST_ODDS * (clean + 0.5) / n[0])
        if not fit.any():
            break
        best = int(np.where(fit, marked, -1).argmax())
        found.append(words[best])
        open_doc[doc[at == best]] = False
    return np.array(found, np.uint64)


def train_field(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights by bucket (the last is the bias) and transition weights."""
    weights, transitions = np.zeros(BUCKETS + 1), np.zeros((3, 2))
    weights[-1] = -4.0
    once = sorted(set(zip(texts, labels)))
    if not once:
        return weights, transitions
    features, cores = [], []
    for text, _ in once:
        view = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        starts, ends = word_spans(view, np.array([0, len(view)]))
        features.append(word_features(view, starts, ends) if len(starts) else np.zeros((0, WIDTH), np.uint64))
        cores.append(np.unique(features[-1][:, 1:]))
    toxic = np.array([y == 1 for _, y in once])
    lexicon = learn_lexicon(cores, toxic)
    truth = [np.isin(f[:, 1:], lexicon).any(axis=1) & t for f, t in zip(features, toxic)]
    index = [(f >> np.uint64(64 - 18)).astype(np.int64) for f in features]
    squares, moved = np.full(BUCKETS + 1, 1e-2), np.full((3, 2), 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(once))
        for at in range(0, len(order), BATCH):
            own = [k for k in order[at : at + BATCH] if len(index[k])]
            if not own:
                continue
            idx, y = np.concatenate([index[k] for k in own]), np.concatenate([truth[k] for k in own])
            first = np.zeros(len(y), bool)
            first[np.cumsum([0] + [len(index[k]) for k in own[:-1]])] = True
            p, expected = marginals(weights[idx].sum(axis=1) + weights[-1], first, transitions)
            gap = (y - p) / len(own)
            g = np.bincount(idx.ravel(), np.repeat(gap, WIDTH), BUCKETS + 1) - DECAY * weights
            g[-1] = gap.sum()
            squares += g * g
            weights += RATE * g / np.sqrt(squares)
            seen = np.zeros((3, 2))
            np.add.at(seen, (np.where(first, 2, np.append(0, y[:-1].astype(int))), y.astype(int)), 1)
            step = (seen - expected) / len(own)
            moved += step * step
            transitions += RATE * step / np.sqrt(moved)
    return weights, transitions


def _train(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values(["turn", "text"])
    weights, transitions = train_field(sample["text"].tolist(), sample["label"].tolist())
    return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "transitions": [transitions.tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The field learned from about ``rows`` labelled documents of each class outside the held-out fold.

    Without labelled rows every word is improbably toxic.  A document labelled twice counts with its larger label.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(fold(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    sample = hash_sample(known.filter("label = 0"), "doc_id", rows, 13).unionAll(hash_sample(known.filter("label = 1"), "doc_id", rows, 13))
    sample = sample.select("doc_id", "label", F.xxhash64("doc_id", F.lit(31)).alias("turn"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    found = (
        texts.join(F.broadcast(sample), "doc_id")  # fewer than 4 * rows narrow rows
        .select("turn", "label", "text").limit(5 * rows)
        .groupBy(F.lit(0).alias("one")).applyInPandas(_train, "weights binary, transitions binary").first()
    )
    if not found:
        return train_field([], [])
    return np.frombuffer(found["weights"], np.float32).astype(np.float64), np.frombuffer(found["transitions"]).reshape(3, 2)


def tag(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], columns: list[str]) -> DataFrame:
    """``docs.select(columns)``, ``__score__`` and ``__spans__``: offending (start, end) in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, transitions = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for a, b in row_groups(offsets):
                part = offsets[a : b + 1] - offsets[a]
                view = data[offsets[a] : offsets[b]]
                starts, ends = word_spans(view, part)
                if not len(starts):
                    continue
                index = (word_features(view, starts, ends) >> np.uint64(64 - 18)).astype(np.int64)
                row = np.searchsorted(part, starts, side="right") - 1
                first = np.append(True, row[1:] != row[:-1])
                p, _ = marginals(weights[index].sum(axis=1) + weights[-1], first, transitions)
                heads = np.flatnonzero(first)
                scores[a + row[heads]] = np.maximum.reduceat(p, heads)
                hits = np.flatnonzero(p >= THRESHOLD)
                if len(hits):
                    chars = np.concatenate(([0], np.cumsum((view & 0xC0) != 0x80)))
                    base = chars[part[row[hits]]]
                    for r, s, e in zip((a + row[hits]).tolist(), (chars[starts[hits]] - base).tolist(), (chars[ends[hits]] - base).tolist()):
                        spans[r].append({"start": s, "end": e})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores), pa.array(spans, kind)], names=[*batch.schema.names[:-1], "__score__", "__spans__"]
            )

    narrow = docs.select(*columns, F.col("text").cast("string").alias("__text__"))
    schema = narrow.drop("__text__").schema.add("__score__", "double").add("__spans__", SPANS)
    return narrow.mapInArrow(tagged, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` for every row of ``docs``.

    Null, empty and wordless texts score 0.  Only the text decides, read whole; equal texts get equal answers, a
    null id keeps its row, repeated rows are scored each, and an empty table gives an empty result.
    """
    found = tag(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), ["doc_id"])
    return found.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("__score__").alias("score"),
        (F.col("__score__") >= threshold).cast("int").alias("predicted"), F.col("__spans__").alias("spans"),
    )


def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

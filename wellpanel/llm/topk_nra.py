"""Exact top-k inner products by no-random-access aggregation of sorted lists.

A query's score is the sum of its dimensions' contributions.  Each dimension is a list sorted by component, read
from the end that suits the query's sign.  After each stretch of reading, every candidate has a lower bound (its
unread dimensions at the worst value of their lists) and an upper bound (at the value just read).  Candidates
whose upper bound is below the k-th lower bound are out; when few are left, reading stops and their final
scores are resolved.

Vectors are dealt by hash to shards and queries to blocks; a cell is one shard read for one block of queries, so
memory is fixed and no task sees all vectors.  Cells return k rows a query, merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellpanel.llm.storage import table

K, QUERY_STEP, SCALE = 5, 50, 256
SHARD, QUERY_BLOCK = 2048, 512
#: Shares of the lists read before the bounds are compared, and the share of candidates left at which reading stops.
STRETCHES, FEW = (0.5, 0.75, 0.9, 1.0), 0.1
LONG = np.iinfo(np.int64)


def bounds(x: np.ndarray, q: np.ndarray, depth: int, rank: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (candidates by queries) after ``depth`` entries of every list.

    ``rank`` is each component's place in its list from the top, ``listed`` the lists themselves.
    """
    n = len(x)
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
    from_top, from_end = rank < depth, n - 1 - rank < depth
    read = (x * from_top) @ up + (x * from_end) @ down
    open_top, open_end = (~from_top).astype(x.dtype), (~from_end).astype(x.dtype)
    top, end = listed[depth - 1][:, None], listed[n - depth][:, None]
    worst_top, worst_end = listed[-1][:, None], listed[0][:, None]
    lower = read + open_top @ (up * worst_top) + open_end @ (down * worst_end)
    upper = read + open_top @ (up * top) + open_end @ (down * end)
    return lower, upper


def top_k(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query, its own id left out."""
    n, width = x.shape
    own = ids[:, None] == query_ids[None, :]
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width)
    alive = ~own
    if most < 2**53 and n > k and width:
        kind = np.float32 if most < 2**24 else np.float64  # integers of this size are exact
        xf, qf = x.astype(kind), q.astype(kind)
        order = np.argsort(-xf, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        listed = np.take_along_axis(xf, order, axis=0)
        for stretch in STRETCHES:
            lower, upper = bounds(xf, qf, max(1, int(n * stretch)), rank, listed)
            lower[own] = -np.inf
            kth = np.partition(lower, n - k, axis=0)[n - k]
            alive &= upper >= kth
            if alive.mean() <= FEW:
                break
    exact = (lambda a: a.astype(np.int64)) if most < 2**62 else (lambda a: np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object))
    out = []
    for j in range(len(query_ids)):
        left = np.flatnonzero(alive[:, j])
        scores = np.array([max(LONG.min, min(LONG.max, int(s))) for s in (exact(x[left]) * exact(q[j])).sum(axis=1)], np.int64)
        best = np.lexsort((ids[left], -np.maximum(scores, LONG.min + 1)))[:k]
        out += [(int(query_ids[j]), int(ids[left[b]]), int(scores[b])) for b in best]
    return out


def _cell(k: int):
    def read(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("vec_id", kind="stable").drop_duplicates(["is_query", "vec_id"])
        found = []
        for _, same in members.groupby(members["embedding"].map(len)):
            asked = same["is_query"].to_numpy()
            values = np.floor(SCALE * np.stack(same["embedding"].to_numpy()).astype(np.float64))
            ids = same["vec_id"].to_numpy()
            if asked.any() and not asked.all():
                found += top_k(ids[~asked], values[~asked], ids[asked], values[asked], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return read


def search(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best for every row whose ``vec_id`` is divisible by ``query_step``.

    Components are floor(256 * x); scores are integer inner products, ties go to the smaller id, and with fewer than
    k candidates all are returned.  Vectors that are null or hold null or non-finite components take no part, nor do
    rows without an id.  Rows that repeat an id count once; vectors of other lengths do not meet.  Scores beyond a
    long are held at its ends.  An empty table gives an empty result.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    asked = valid.filter(F.col("vec_id") % query_step == 0)
    n, m = valid.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERY_BLOCK))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    candidates = valid.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("is_query"), "vec_id", "embedding")
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.lit(True).alias("is_query"), "vec_id", "embedding")
    found = candidates.unionAll(queries).groupBy("shard", "block").applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""

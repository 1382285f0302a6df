"""Centroid clustering by Lloyd's rounds in integers, with distances filtered in rotated coordinates.

Vectors are rotated onto their principal axes once; stored are the leading coordinates and the norm of the rest.
With any orthonormal axes, the squared distance of the leading coordinates plus the squared difference of the two
residual norms is a lower bound of the squared distance.  A round takes the centroid of the least bound, computes that
distance in integers, and verifies in integers only those centroids whose bound does not exceed it.

The axes come from MLlib's distributed PCA; they decide how many centroids survive, never the result.  A round is one
pass over the stored vectors that leaves one row of sums a cluster and task, added up by Spark; the driver sees one
row a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import staged, table

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
LEADING = 16
#: Up to this size squared distances of WIDTH components fit a long; larger components are computed as Python integers.
LARGEST = 1 << 25
LONG = np.iinfo(np.int64)
#: Share of the squared norms, and fixed part, by which rounding may raise a bound above the true distance.
SLACK, SLACK_AT_LEAST = 1e-9, 1.0
PARTIAL = "cluster int, place int, amount string"


def kept_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(vec_id, embedding)`` with ``width`` finite components, as doubles."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.filter((F.size("embedding") == width) & ~bad)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("embedding"))
    )


def integers(values: np.ndarray, large: bool) -> np.ndarray:
    """floor(SCALE * x) of doubles, exact; SCALE is a power of two, so only the largest doubles need the slow way."""
    if not large:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([[int(x) * SCALE + int(np.floor((x - int(x)) * SCALE)) for x in row] for row in values.tolist()], object).reshape(values.shape)


def axes(kept: DataFrame, leading: int = LEADING, width: int = WIDTH) -> np.ndarray:
    """``width`` by ``leading`` orthonormal columns: principal axes where MLlib finds them, else unit vectors."""
    plain = np.eye(width)[:, :leading]
    if len(kept.head(2)) < 2:
        return plain
    found = PCA(k=leading, inputCol="v", outputCol="r").fit(kept.select(array_to_vector(F.transform("embedding", lambda c: F.floor(c * SCALE).cast("double"))).alias("v"))).pc.toArray()
    return np.linalg.qr(found)[0] if np.isfinite(found).all() else plain


def rotated(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and residual norms."""
    x = x.astype(np.float64)
    lead = x @ rotation
    return lead, np.sqrt(np.maximum((x * x).sum(axis=1) - (lead * lead).sum(axis=1), 0.0))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed in integers) of every row of ``x``; ties to the smaller number."""
    far, kept = rotated(centroids, rotation)
    if x.dtype == object:
        own, candidates = np.zeros(len(x), np.int64), np.ones((len(x), len(centroids)), bool)
    else:
        bound = (lead * lead).sum(axis=1)[:, None] + (far * far).sum(axis=1)[None, :] - 2 * lead @ far.T + (rest[:, None] - kept[None, :]) ** 2
        norms = (lead * lead).sum(axis=1) + rest * rest
        slack = SLACK * (norms[:, None] + ((far * far).sum(axis=1) + kept * kept)[None, :]) + SLACK_AT_LEAST
        own = bound.argmin(axis=1)
        gap = x - centroids[own]
        candidates = bound - slack <= (gap * gap).sum(axis=1)[:, None].astype(np.float64)
    best, cluster, verified = None, own, 0
    for number in range(len(centroids)):
        rows = np.flatnonzero(candidates[:, number])
        gap = x[rows] - centroids[number]
        distance = (gap * gap).sum(axis=1)
        verified += len(rows)
        if best is None:
            best = np.full(len(x), -1, x.dtype if x.dtype == object else np.int64)
            cluster = np.full(len(x), -1, np.int64)
        better = (cluster[rows] < 0) | (distance < best[rows])
        best[rows[better]], cluster[rows[better]] = distance[better], number
    return cluster, best, verified


def _batches(batches: Iterator[pa.RecordBatch], large: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False))
            lead = np.stack(batch.column("lead").to_numpy(zero_copy_only=False))
            yield batch, integers(x, large), lead, batch.column("rest").to_numpy()


def _sums(model, large: bool):
    """Per cluster and task: members, inertia and the component sums, one row each, as decimal text."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, rotation = model.value
        k, width = centroids.shape
        total = np.zeros((k, 2 + width), object)
        for _, x, lead, rest in _batches(batches, large):
            cluster, distance, _ = nearest(x, lead, rest, centroids, rotation)
            for number in np.unique(cluster).tolist():
                rows = np.flatnonzero(cluster == number)
                total[number, 0] += len(rows)
                total[number, 1] += sum(distance[rows].tolist())
                total[number, 2:] += x[rows].sum(axis=0).astype(object)
        seen = [n for n in range(k) if total[n, 0]]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(seen, 2 + width), pa.int32()), "place": pa.array(np.tile(np.arange(2 + width), len(seen)), pa.int32()),
            "amount": pa.array([str(v) for n in seen for v in total[n]], pa.string()),
        })

    return summed


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cluster": rows["cluster"].iloc[:1], "place": rows["place"].iloc[:1], "amount": [str(sum(map(int, rows["amount"])))]})


def totals(stored: DataFrame, centroids: np.ndarray, rotation: np.ndarray, large: bool) -> dict[int, tuple[int, int, list[int]]]:
    """Members, inertia and component sums of each cluster that is not empty."""
    model = stored.sparkSession.sparkContext.broadcast((centroids, rotation))
    parts = stored.mapInArrow(_sums(model, large), PARTIAL)
    if large:  # beyond any decimal: one short row a task, added in Python
        added = parts.groupBy("cluster", "place").applyInPandas(_add, PARTIAL)
    else:
        added = parts.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).cast("string").alias("amount"))
    found: dict[int, list[int]] = {}
    for r in sorted(added.collect()):  # a row a cluster and component
        found.setdefault(r.cluster, []).append(int(r.amount))
    return {n: (amounts[0], amounts[1], amounts[2:]) for n, amounts in found.items()}


def _assign(model, large: bool):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, rotation = model.value
        for batch, x, lead, rest in _batches(batches, large):
            cluster, distance, _ = nearest(x, lead, rest, centroids, rotation)
            held = [min(LONG.max, d) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())], names=["vec_id", "cluster", "distance"])

    return assigned


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector.

    Left out are vectors that are null, of another width, or hold null or non-finite components.  The first centroids
    are the vectors with the smallest sha256 of ``3:<vec_id>``; repeated ids go by their components, and rows without an
    id come last.  With fewer vectors than clusters each starts one.  A cluster that loses all vectors keeps its centroid.
    Distances and inertias beyond a long are held at its end; the sums behind them are exact.  An empty table gives an
    empty result, repeated rows count each, and other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, width)
    rotation = axes(kept, min(LEADING, width), width)
    shared = spark.sparkContext.broadcast(rotation)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False))
                lead, rest = rotated(np.floor(values * SCALE), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)], names=[*batch.schema.names, "lead", "rest"])

    stored = staged(kept.mapInArrow(rotate, "vec_id long, embedding array<double>, lead array<double>, rest double"), "rotated")
    largest = stored.agg(F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))))).first()[0]
    if largest is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    large = largest * SCALE >= LARGEST
    hashed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = stored.select("vec_id", "embedding", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "embedding").limit(clusters).collect()
    centroids = integers(np.array([r.embedding for r in first]), large)
    for _ in range(rounds):
        for number, (members, _, sums) in totals(stored, centroids, rotation, large).items():
            centroids[number] = [s // members for s in sums]
    last = totals(stored, centroids, rotation, large)
    whole = min(LONG.max, sum(inertia for _, inertia, _ in last.values()))
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(n, min(LONG.max, last[n][1]), whole, digests[n]) for n in last], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    model = spark.sparkContext.broadcast((centroids, rotation))
    found = stored.mapInArrow(_assign(model, large), "vec_id long, cluster int, distance long")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster


def op13_pca_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, e AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {CLUSTERS}))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (SELECT vec_id, e, cluster, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v CROSS JOIN c{k}),
a{k} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{k} GROUP BY vec_id)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{k}, unnest(range(1, {WIDTH + 1})) AS u(i) GROUP BY cluster, i),
m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)
"""


SQL = _sql()

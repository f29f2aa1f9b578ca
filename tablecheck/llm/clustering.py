"""Centroid clustering of vectors in exact integers, with a PCA-rotated filter.

Components become integers, so that assignment, ties and centroids are the same on every run and
any number of tasks. A table keeps of every vector its integers, its ``leading`` coordinates along
the main axes of all vectors, and the norm of what these leave out. For a vector and a centroid,

    |projected difference|^2 + (residual norm - residual norm)^2  <=  distance^2,

so the centroid with the least bound is measured first, and then only those whose bound, less a
margin for rounding, is not above that distance. All distances are measured in 64-bit integers.

One round is one scan: a task adds up the vectors of each cluster, and only sums come back, as many
numbers as the centroids have. The axes come from the second moments of all vectors in one scan.

Defined cases: null vectors, vectors of another length, with null or non-finite components, and with
components whose integer is beyond 2^27 (their distances would not fit a long) are left out. A null
vec_id is hashed as empty text; rows that repeat an id are vectors of their own, and among equal
hashes the smaller components come first as starts. Fewer vectors than centroids give as many
centroids as vectors; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import written

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
LEADING = 16
LIMIT = 1 << 27
MARGIN = 1e-9  # of the squared norms, far above the rounding of the bound
LARGEST = (1 << 63) - 1


def integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and the integers of these, one row each."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    flat = pc.list_flatten(column.filter(fits)).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * flat).reshape(-1, width)
    usable = (np.abs(scaled) <= LIMIT).all(axis=1)  # false for nulls and what is not finite
    (rows,) = np.nonzero(fits.to_numpy(zero_copy_only=False))
    return rows[usable], scaled[usable].astype(np.int32)


def blob(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _kept(batches, width: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = integers(batch.column("embedding"), width, scale)
        ids = batch.column("vec_id").take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([ids, blob(values)], names=["vec_id", "x"])


def _moments(batches, width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width + 1, width + 1))
    for batch in batches:
        x = matrix(batch.column("x"), np.int32, width).astype(np.float64)
        x = np.hstack([x, np.ones((len(x), 1))])
        total += x.T @ x
    flat = total.ravel()
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"]
    )


@dataclass
class Axes:
    """Middle of all vectors and the leading directions about it."""

    middle: np.ndarray
    main: np.ndarray

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms."""
        moved = x - self.middle
        lead = moved @ self.main
        rest = (moved * moved).sum(axis=1) - (lead * lead).sum(axis=1)
        return lead, np.sqrt(np.maximum(rest, 0))


def axes(kept: DataFrame, width: int, leading: int) -> Axes:
    """From the second moments of all vectors; (width + 1)^2 numbers come back."""
    found = kept.select("x").mapInArrow(lambda b: _moments(b, width), "place long, value double")
    total = np.zeros((width + 1) * (width + 1))
    for row in found.groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row.place] = row.value
    total = total.reshape(width + 1, width + 1)
    count = max(total[width, width], 1.0)
    middle = total[width, :width] / count
    spread = total[:width, :width] / count - np.outer(middle, middle)
    return Axes(middle, np.linalg.eigh(spread)[1][:, ::-1][:, :leading])


def _turned(batches, found: Axes, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lead, rest = found.of(matrix(batch.column("x"), np.int32, width))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, blob(lead), pa.array(rest)], names=["vec_id", "x", "lead", "rest"]
        )


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def nearest(x, lead, rest, centroids: np.ndarray, found: Axes):
    """Cluster and squared distance of every vector, and how many distances were measured."""
    to, short = found.of(centroids)
    own, other = (lead * lead).sum(axis=1), (to * to).sum(axis=1)
    norms = own[:, None] + other
    bound = norms - 2 * lead @ to.T + (rest[:, None] - short) ** 2
    bound -= MARGIN * (norms + (rest * rest)[:, None] + short * short)
    cluster = bound.argmin(axis=1)
    best = exact(x, centroids[cluster])
    open_ = bound <= best[:, None]
    open_[np.arange(len(x)), cluster] = False
    measured = len(x)
    for c in range(len(centroids)):
        (rows,) = np.nonzero(open_[:, c])
        distance = exact(x[rows], centroids[c])
        measured += len(rows)
        better = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = distance[better], c
    return cluster, best, measured


def _assigned(batches, centroids: np.ndarray, found: Axes):
    width, leading = found.main.shape
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("x"), np.int32, width).astype(np.int64)
            lead = matrix(batch.column("lead"), np.float64, leading)
            rest = batch.column("rest").to_numpy(zero_copy_only=False)
            yield batch, x, *nearest(x, lead, rest, centroids, found)


def _sums(batches, centroids: np.ndarray, found: Axes) -> Iterator[pa.RecordBatch]:
    count, width = centroids.shape
    total = np.zeros((count, width + 1), np.int64)
    for _, x, cluster, _, _ in _assigned(batches, centroids, found):
        for c in np.unique(cluster):
            own = x[cluster == c]
            total[c, :width] += own.sum(axis=0)
            total[c, width] += len(own)
    flat = total.ravel()
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"]
    )


def moved(turned: DataFrame, centroids: np.ndarray, found: Axes) -> np.ndarray:
    """The centroids after one round; an empty cluster keeps its own."""
    count, width = centroids.shape
    sums = turned.mapInArrow(lambda b: _sums(b, centroids, found), "place long, value long")
    total = np.zeros(count * (width + 1), np.int64)
    for row in sums.groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row.place] = row.value
    total = total.reshape(count, width + 1)
    held = total[:, width] > 0
    after = centroids.copy()
    after[held] = total[held, :width] // total[held, width:]  # floors below zero too
    return after


def _placed(batches, centroids: np.ndarray, found: Axes) -> Iterator[pa.RecordBatch]:
    for batch, _, cluster, best, _ in _assigned(batches, centroids, found):
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(best)],
            names=["vec_id", "cluster", "distance"],
        )


def starts(kept: DataFrame, clusters: int, seed: int, width: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    keyed = kept.select(F.sha2(name, 256).alias("key"), "x").orderBy("key", "x").limit(clusters)
    found = [np.frombuffer(row.x, np.int32) for row in keyed.collect()]
    return np.array(found, np.int64).reshape(-1, width)


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    width: int = WIDTH,
    scale: int = SCALE,
    leading: int = LEADING,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Sums of distances that exceed a long are stated as the largest long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")
    )
    kept = written(rows.mapInArrow(lambda b: _kept(b, width, scale), "vec_id long, x binary"))
    found = axes(kept, width, min(leading, width))
    turned = written(
        kept.mapInArrow(
            lambda b: _turned(b, found, width), "vec_id long, x binary, lead binary, rest double"
        )
    )
    centroids = starts(kept, clusters, seed, width)
    for _ in range(rounds):
        centroids = moved(turned, centroids, found)
    final = centroids
    placed = written(
        turned.mapInArrow(
            lambda b: _placed(b, final, found), "vec_id long, cluster int, distance long"
        )
    )
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {row.cluster: int(row.s) for row in sums.collect()}
    whole = min(sum(inertia.values()), LARGEST)
    named = [
        (
            c, min(inertia.get(c, 0), LARGEST), whole,
            hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(),
        )
        for c, row in enumerate(final.tolist())
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return placed.join(F.broadcast(spark.createDataFrame(named, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

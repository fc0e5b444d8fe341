"""Exact integer k-means with PCA-rotated filtering (operator 12).

Vectors become integers once. One pass over all of them gives their mean and covariance; the eigenvectors
of the largest eigenvalues give a rotation, and every vector is stored with its leading rotated coordinates and
the norm of the rest of it. For a vector and a centroid, the squared distance of the leading coordinates plus the
squared difference of the two residual norms is never more than their squared distance. A round computes this
bound for all centroids, measures the most promising one in integers, and measures in integers each other centroid
whose bound does not exceed that distance. Bounds only decide what is measured, so rounding cannot make a result
wrong: they are lowered by more than the error that floating point can have made.

Centroids (a few numbers each) go to all tasks. Each task adds up its vectors by cluster, so that a round shuffles
one row per cluster and component and task, and the driver sees one number per cluster and component.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.llm.common import settle

#: Integers beyond this could make a squared distance of 64 components exceed 64 bits.
LARGEST = 1 << 27
#: Rows measured at once.
BLOCK = 4096


@dataclass(frozen=True)
class Rotation:
    """``mean`` of the vectors and orthonormal leading directions as the columns of ``basis``."""

    mean: np.ndarray
    basis: np.ndarray

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms of rows of integers."""
        centred = vectors - self.mean
        leading = centred @ self.basis
        rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", leading, leading)
        return leading, np.sqrt(np.maximum(rest, 0.0))


@dataclass(frozen=True)
class Clusters:
    """``assigned`` (the id, ``cluster`` and squared ``distance`` of every kept vector) and the final centroids."""

    assigned: DataFrame
    centroids: np.ndarray


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """``vec_id, v``: the floors of ``scale`` times the components of each vector that is kept."""
    vector = df[vector_column]
    whole = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(df[id_column].alias("vec_id"), whole.alias("x")).where(vector.isNotNull() & (F.size(vector) == size))
    limit = float(LARGEST)
    # Null, NaN and infinity fail the comparison as well.
    sound = F.forall("x", lambda x: F.coalesce((scale * x >= -limit) & (scale * x < limit), F.lit(False)))
    return rows.where(sound).select("vec_id", F.transform("x", lambda x: F.floor(scale * x).cast("int")).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The rows of a list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def fit_rotation(vectors: DataFrame, size: int, leading: int) -> Rotation:
    """The rotation of all rows of ``vectors``; one row per task is added up, none is collected."""

    def add_up(batches):
        # Coordinates and their products about the first vector of the task, moved to zero afterwards.
        count, total, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            block = _matrix(batch.column(0), size).astype(np.float64)
            count, total, products = count + len(block), total + block.sum(axis=0), products + block.T @ block
        sums = np.concatenate([[float(count)], total, products.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(sums), dtype=np.int32)), "x": pa.array(sums)})

    sums = vectors.select("v").mapInArrow(add_up, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    found = sums.toPandas()
    flat = np.zeros(1 + size + size * size)
    flat[found["at"].to_numpy()] = found["x"].to_numpy()
    count = max(flat[0], 1.0)
    mean = flat[1 : 1 + size] / count
    covariance = flat[1 + size :].reshape(size, size) / count - np.outer(mean, mean)
    _, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    return Rotation(np.round(mean), np.ascontiguousarray(directions[:, ::-1][:, :leading]))


def rotated(vectors: DataFrame, rotation: Rotation, size: int) -> DataFrame:
    """``vectors`` with their leading rotated coordinates (``leading``) and residual norms (``rest``)."""

    def run(batches):
        for batch in batches:
            leading, rest = rotation(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(leading), pa.array(rest)], ["vec_id", "v", "leading", "rest"])

    schema = T.StructType(
        [*vectors.schema.fields, T.StructField("leading", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())]
    )
    return vectors.mapInArrow(run, schema)


def nearest(
    vectors: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation
) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the first of equals), the squared distances, and how many were measured."""
    ours, theirs = rotation(centroids)
    squares = (leading * leading).sum(axis=1)[:, None] + (ours * ours).sum(axis=1) - 2 * (leading @ ours.T)
    bound = squares + (rest[:, None] - theirs) ** 2
    # More than rounding can add to a bound: a residual norm near zero is off by some 1e-8 of the vector's norm.
    size = (squares.max(axis=1, initial=0.0) + rest**2 + (leading * leading).sum(axis=1)) + float((theirs**2).max(initial=0.0))
    bound -= (1.0 + 1e-6 * size)[:, None]
    wide = vectors.astype(np.int64)

    def measure(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = wide[rows] - centroids[which]
        return np.einsum("ij,ij->i", apart, apart)

    every = np.arange(len(vectors))
    best = bound.argmin(axis=1)
    least = measure(every, best)
    open_ = bound <= least[:, None]
    open_[every, best] = False
    for number in range(len(centroids)):
        rows = np.flatnonzero(open_[:, number])
        found = measure(rows, np.full(len(rows), number))
        better = (found < least[rows]) | ((found == least[rows]) & (number < best[rows]))
        best[rows[better]], least[rows[better]] = number, found[better]
    return best, least, len(vectors) + int(open_.sum())


def _blocks(batches, size: int, leading: int):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            yield columns, (_matrix(columns["v"], size), _matrix(columns["leading"], leading), columns["rest"].to_numpy())


def moved(points: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors; empty ones stay."""
    number, size = centroids.shape
    leading = rotation.basis.shape[1]

    def add_up(batches):
        sums, counts = np.zeros((number, size), dtype=np.int64), np.zeros(number, dtype=np.int64)
        for _, (vectors, *rotated_) in _blocks(batches, size, leading):
            best, _, _ = nearest(vectors, *rotated_, centroids, rotation)
            for cluster in np.unique(best):
                members = vectors[best == cluster]
                sums[cluster] += members.sum(axis=0, dtype=np.int64)
                counts[cluster] += len(members)
        used = np.flatnonzero(counts)
        cells = np.concatenate([sums[used], counts[used, None]], axis=1)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(np.repeat(used, size + 1).astype(np.int32)),
                "at": pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(used))),
                "x": pa.array(cells.ravel()),
            }
        )

    cells = points.select("v", "leading", "rest").mapInArrow(add_up, "cluster int, at int, x long")
    # At most one number per cluster and component; sums are decimals, which no count of rows overflows.
    found = cells.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
    sums = {(row["cluster"], row["at"]): int(row["x"]) for row in found}
    out = centroids.copy()
    for cluster in range(number):
        if count := sums.get((cluster, size)):
            out[cluster] = [sums[cluster, at] // count for at in range(size)]
    return out


def k_means(
    df: DataFrame,
    clusters: int = 8,
    rounds: int = 10,
    seed: int = 3,
    size: int = 64,
    scale: int = 1024,
    leading: int = 16,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> Clusters:
    """Exact clusters of the vectors of ``df`` after ``rounds`` rounds.

    Kept are vectors of ``size`` components, none of them null or not finite. A component whose integer would not lie
    within 2**27 is treated as not finite, because squared distances would no longer fit 64 bits. The
    first centroids are the vectors with the smallest sha256 of ``seed:id`` (a null id as the empty text; of equal ids
    the smaller vector first), each row on its own, so repeated rows may give equal centroids, of which the later stays
    without vectors. Fewer vectors than ``clusters`` give fewer centroids; without any the result is empty. Ties go to
    the smaller number. Other columns of ``df`` do not matter.
    """
    vectors = settle(integer_vectors(df, id_column, vector_column, size, scale), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(key, "v").limit(clusters).collect()
    centroids = np.array([row["v"] for row in first], dtype=np.int64).reshape(-1, size)
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return Clusters(df.sparkSession.createDataFrame([], schema), centroids)
    rotation = fit_rotation(vectors, size, leading)
    points = settle(rotated(vectors, rotation, size), "points")
    for _ in range(rounds):
        before, centroids = centroids, moved(points, centroids, rotation)
        if np.array_equal(before, centroids):
            break  # Further rounds would repeat this one.

    def assign(batches):
        for columns, (vectors, *rotated_) in _blocks(batches, size, leading):
            best, least, _ = nearest(vectors, *rotated_, centroids, rotation)
            found = [pa.array(best.astype(np.int32)), pa.array(least)]
            yield pa.RecordBatch.from_arrays([columns["vec_id"], *found], schema.names)

    return Clusters(settle(points.mapInArrow(assign, schema), "assigned"), centroids)


def cluster_report(df: DataFrame, **parameters) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    found = k_means(df, **parameters)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()
    total = sum(int(row["inertia"]) for row in sums)
    rows = [Row(row["cluster"], int(row["inertia"]), total, digests[row["cluster"]]) for row in sums]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    per_cluster = df.sparkSession.createDataFrame(rows, schema)
    joined = found.assigned.join(F.broadcast(per_cluster), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

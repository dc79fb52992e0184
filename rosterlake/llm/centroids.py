"""Centroid clustering of integer vectors, with Ptolemaic pivots.

Lloyd's rounds: every vector goes to its nearest centroid, then a centroid becomes the floor of its vectors' mean. For any four
points d(v, c) d(p, s) >= |d(v, p) d(c, s) - d(v, s) d(c, p)|. The distances of all vectors to a few fixed pivots are computed
once and stored beside them; in each round those of the centroids are new, and each pair of pivots gives a lower bound of the
distance from a vector to a centroid without looking at its components. The exact distance to the centroid with the least
bound is an upper bound; centroids whose lower bound, less a slack well over any rounding, does not exceed it are compared
exactly in integers, ties to the smaller number. So the pivots save comparisons and change no result.

A round is one scan of the stored vectors; a task sends the sum and number of its vectors for each centroid, the driver gets a
row for each centroid. Vectors that are null, have another number of components, or hold null or non-finite ones take no part.
Components beyond 2^27 in size raise an error, as a squared distance would not fit a long. A null id is clustered and starts no
centroid before others; repeated rows count as often as they stand there. Other columns are not read, whatever their names.
Without vectors there are no rows; with fewer than k there are as many centroids as vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CENTROIDS, ROUNDS, SCALE, SEED = 40, 5, 256, 2
#: Pivots, and pairs of them that give bounds.
PIVOTS, PAIRS = 8, 12
#: Share by which bounds are lowered, far more than what doubles lose.
SLACK = 1e-9
#: Components of survivors that are compared at a time.
PIECE = 1 << 20
LARGEST = 1 << 27


def whole_vectors(embeddings: DataFrame, size: int = 64, scale: int = SCALE) -> DataFrame:
    """vec_id, x: floor(scale * component) of the vectors that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = embeddings.where(F.coalesce((F.size(e) == size) & ~bad, F.lit(False)))
    x = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    x = F.when(F.exists(x, lambda v: F.abs(v) > LARGEST), F.raise_error(F.lit("a component is too large for squared distances in a long"))).otherwise(x)
    return rows.select("vec_id", x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.einsum("...i,...i->...", diff, diff)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[vector, pivot] as doubles."""
    return np.stack([np.sqrt(squared(x, p).astype(np.float64)) for p in pivots], axis=-1)


def choose_pivots(start: np.ndarray, count: int = PIVOTS, pairs: int = PAIRS) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Pivots among the starting vectors, each far from those before, and the pairs that are farthest apart."""
    chosen, far = [0], squared(start, start[0])
    while len(chosen) < min(count, len(start)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(start, start[chosen[-1]]))
    pivots = start[chosen]
    between = distances(pivots, pivots)
    found = sorted(((a, b, float(between[a, b])) for a, b in combinations(range(len(chosen)), 2)), key=lambda t: -t[2])
    return pivots, found[:pairs]


class Nearest:
    """The nearest of some centroids."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int, float]]):
        self.centroids, self.pairs, self.far = centroids, pairs, distances(centroids, pivots)

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """[vector, centroid]: what the distance is at least, by the vectors' distances to the pivots."""
        low = np.zeros((len(far), len(self.centroids)))
        for a, b, apart in self.pairs:
            one, two = far[:, a, None] * self.far[None, :, b], far[:, b, None] * self.far[None, :, a]
            np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / apart, out=low)
        return low * (1 - SLACK)

    def find(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, exact comparisons made)."""
        low = self.bounds(far)
        guess = low.argmin(axis=1)
        best = squared(x, self.centroids[guess])
        near = low * low * (1 - SLACK) <= best[:, None]
        near[np.arange(len(x)), guess] = True
        row, col = np.nonzero(near)
        exact = np.empty(len(row), np.int64)
        step = max(1, PIECE // x.shape[1])
        for at in range(0, len(row), step):
            part = slice(at, at + step)
            exact[part] = squared(x[row[part]], self.centroids[col[part]])
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, first) if len(x) else best
        hit = np.flatnonzero(exact == best[row])  # by row, then by centroid
        return col[hit[np.searchsorted(row[hit], np.arange(len(x)))]], best, len(row)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with far, the distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column("x"), pivots.shape[1]), pivots)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], ["vec_id", "x", "far"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, x array<bigint>, far array<double>")


def sums(stored: DataFrame, nearest: Nearest, pivots: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors, their number and the sums of their components."""
    k, size = nearest.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), size)
            own, _, _ = nearest.find(x, matrix(batch.column("far"), pivots))
            for j in np.unique(own):
                total[j] += x[own == j].sum(axis=0)
            count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]), "total": pa.array(list(total[some]), pa.list_(pa.int64()))})

    parts = stored.select("x", "far").mapInArrow(run, "cluster int, n long, total array<bigint>").groupBy("cluster")
    rows = parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(size)]).alias("total"))
    return {r.cluster: (r.n, r.total) for r in rows.collect()}


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors (vec_id, x), all of one length."""
    hashed = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    start = vectors.orderBy(hashed.asc_nulls_last(), "x").limit(k).collect()
    spark = vectors.sparkSession
    if not start:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in start], np.int64)
    pivots, pairs = choose_pivots(centroids)
    stored = common.written(with_pivots(vectors, pivots), "vectors")
    for _ in range(rounds):
        for j, (n, total) in sums(stored, Nearest(centroids, pivots, pairs), len(pivots)).items():
            centroids[j] = [t // n for t in total]
    nearest, size = Nearest(centroids, pivots, pairs), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far, _ = nearest.find(matrix(batch.column("x"), size), matrix(batch.column("far"), len(pivots)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    found = common.written(stored.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    about = [(j, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, n in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

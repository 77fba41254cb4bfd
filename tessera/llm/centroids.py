"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.sources.config import config_frame

#: Centroids, rounds, components and steps per unit of the registered query.
CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: The seeds are the vectors with the smallest sha256 of this and their id.
SEED_PREFIX = "3:"
#: Cells (vector, component, seen centroid) that one step of the search holds at a time.
STEP_CELLS = 1 << 21


def finite_vector(column: str) -> Column:
    """Whether an array column is there and holds neither nulls nor non-finite numbers."""
    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(sound(x.cast("double")), F.lit(False)))


def scaled_vector(column: str, scale: int) -> Column:
    """Every component as the integer ``floor(scale * x)``, x as double."""
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A list column of ``dimensions`` integers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


class CentroidLists:
    """Per component, the centroids in the order of their value there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T
        self.values = np.sort(centroids, axis=0).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centroid (the smallest of equals) and its distance."""
        k, d = self.centroids.shape
        step = max(1, STEP_CELLS // (d * min(k, d)))
        parts = [self._nearest(x[a:a + step]) for a in range(0, len(x), step)]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *p]) for p in (zip(*parts) if parts else ((), ())))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, d = self.centroids.shape
        most = np.iinfo(np.int64).max
        number, best = np.full(len(x), k), np.full(len(x), most)
        seen = np.zeros((len(x), k), bool)
        above = np.stack([np.searchsorted(self.values[j], x[:, j]) for j in range(d)], axis=1)
        below = above - 1
        lists = np.arange(d)
        open_ = np.arange(len(x))
        while len(open_):
            own, lo, hi = x[open_], below[open_], above[open_]
            down = np.where(lo >= 0, own - self.values[lists, np.maximum(lo, 0)], most)
            up = np.where(hi < k, self.values[lists, np.minimum(hi, k - 1)] - own, most)
            # one step outward in every list, to the nearer side
            go_down = down <= up
            frontier = np.square(np.where(go_down, down, up)).sum(axis=1)
            met = np.zeros((len(open_), k), bool)
            met[np.arange(len(open_))[:, None], self.order[lists, np.where(go_down, lo, hi)]] = True
            met &= ~seen[open_]
            row, c = np.nonzero(met)
            exact = np.square(own[row] - self.centroids[c]).sum(axis=1)
            # by row, then distance, then number: the first of a row is its best new centroid
            order = np.lexsort((c, exact, row))
            row, c, exact = row[order], c[order], exact[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            at, c, exact = open_[row[first]], c[first], exact[first]
            better = (exact < best[at]) | (exact == best[at]) & (c < number[at])
            number[at[better]], best[at[better]] = c[better], exact[better]
            seen[open_] |= met
            below[open_], above[open_] = lo - go_down, hi + ~go_down
            # an unseen centroid lies at least the frontier away in every list
            open_ = open_[(frontier <= best[open_]) & ~seen[open_].all(axis=1)]
        return number, best


def _seeds(points: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id: a top-k."""
    by = F.sha2(F.concat(F.lit(SEED_PREFIX), F.col("vec_id").cast("string")), 256)
    rows = points.select(by.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid as the floor of its vectors' mean, exactly; empty ones stay. A task
    gives one row of sums per centroid it has met; their totals come to the driver."""
    d = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = CentroidLists(centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            x = matrix(batch.column("v"), d)
            number, _ = lists.nearest(x)
            n += np.bincount(number, minlength=len(n))
            np.add.at(sums, number, x)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    parts = points.select("v").mapInArrow(work, "cluster long, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    moved = centroids.copy()
    for r in total.collect():
        moved[r["cluster"], r["i"]] = r["s"] // r["n"]
    return moved


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
                    scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector.

    ``vectors``: ``vec_id, embedding``; those with exactly ``dimensions`` components, none
    null or non-finite, take part, as integers ``floor(scale * x)``. The seeds are the ``k``
    vectors with the smallest sha256 of ``3:<vec_id>`` (all, if fewer; null ids last, equal
    hashes by their components). A round sends every vector to its nearest centroid (ties:
    the smaller number) and moves each centroid to the exact floor of its vectors' mean, an
    empty one stays; a round that moves nothing is the last, since all later ones would
    repeat it. Distances are squared Euclidean, exact in 64 bits: larger vectors raise an
    error. Repeated rows are vectors of their own; other columns are ignored; an empty table
    gives an empty result.

    What reaches the driver: the seeds, and ``k`` times ``dimensions`` totals per round.
    """
    limit = int(np.sqrt(((1 << 63) - 1) // dimensions)) // 2
    v = scaled_vector("embedding", scale)
    sound = vectors.where((F.size("embedding") == dimensions) & finite_vector("embedding")).select("vec_id", v.alias("v"))
    in_range = F.forall("v", lambda x: (x >= -limit) & (x <= limit))
    points = materialize(sound.withColumn("v", F.when(in_range, F.col("v")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {limit}: distances need more than 64 bits")))), "centroid_points")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    spark = vectors.sparkSession

    centroids = _seeds(points, k)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    for _ in range(rounds):
        moved = _moved(points, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = CentroidLists(centroids)
        for batch in batches:
            number, distance = lists.nearest(matrix(batch.column("v"), dimensions))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    assigned = materialize(points.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "centroid_assigned")
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = config_frame(
        spark, [(c, s, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

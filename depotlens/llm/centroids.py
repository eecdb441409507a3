"""Centroid clustering with Yinyang bounds.

The centroids are put into groups once, by their places at the start. A vector
keeps an upper bound of the distance to its centroid and one lower bound for each
group; when centroids move, the bounds move with them. A vector whose upper bound
lies below all its lower bounds keeps its cluster unseen (global filter); of the
others only the groups whose bound is reached are opened (group filter), and
their centroids are compared exactly, in whole numbers. Bounds are floating-point
and get a margin, so that a tie or a near tie is always decided exactly.

A round is one pass over the vectors, one small aggregate (sums by cluster, added up
in the tasks before they are shuffled) and k centroids on the driver. The state
of each round is written to the shared folder, so a lost executor costs tasks of
one round only. Nothing but the k centroids is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, map_rows
from .vectors import as_lists, as_matrix, is_finite, whole_numbers

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Centroids to a group, on average.
GROUP = 4
#: What floating-point bounds are trusted to, relative to their size.
MARGIN = 1e-9


def group_centroids(centroids: np.ndarray, per_group: int = GROUP) -> np.ndarray:
    """The group of each centroid: Lloyd rounds over the centroids themselves, started from every few of them."""
    k = len(centroids)
    t = max(1, -(-k // per_group))
    c = centroids.astype(float)
    means, group = c[:: max(1, k // t)][:t].copy(), np.zeros(k, np.int64)
    for _ in range(10):
        group = ((c[:, None] - means[None]) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (group == g).any():
                means[g] = c[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


class Yinyang:
    """One assignment: the centroids, their groups and how far they moved since the last one."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.centroids, self.group = centroids, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        moved = centroids.astype(float) - (centroids if before is None else before)
        self.drift = np.sqrt((moved**2).sum(1)) * (1 + MARGIN)
        self.group_drift = np.array([self.drift[m].max() for m in self.members])
        self.exact = 0  # distances that were computed

    def _distances(self, x: np.ndarray, j: int) -> np.ndarray:
        self.exact += len(x)
        return ((x - self.centroids[j]) ** 2).sum(1)

    def _bounds(self, seen: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Lower bounds by group: the least distance seen in it, the vector's own centroid left out."""
        d = np.sqrt(seen)
        d[np.arange(len(d)), best] = np.inf
        return np.stack([d[:, m].min(1) for m in self.members], 1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, distance, upper, lower) of vectors without bounds: every centroid is compared."""
        d = np.stack([self._distances(x, j) for j in range(len(self.centroids))], 1)
        best = d.argmin(1)  # the smaller number where two are as near
        own = d[np.arange(len(x)), best]
        return best, own, np.sqrt(own.astype(float)), self._bounds(d.astype(float), best)

    def again(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same for vectors with bounds from the assignment before."""
        best, own = cluster.copy(), distance.copy()
        upper = upper + self.drift[best]
        lower = lower - self.group_drift
        reached = lambda rows, low: upper[rows] * (1 + MARGIN) + MARGIN >= low
        rows = np.flatnonzero(reached(slice(None), lower.min(1)))
        for j in np.unique(best[rows]):  # the exact distance to the own centroid may be enough
            mine = rows[best[rows] == j]
            own[mine] = self._distances(x[mine], j)
        upper[rows] = np.sqrt(own[rows].astype(float))
        rows = rows[reached(rows, lower[rows].min(1))]
        old = best[rows].copy()
        seen = np.full((len(rows), len(self.centroids)), np.inf)
        seen[np.arange(len(rows)), old] = own[rows]
        opened = np.zeros((len(rows), len(self.members)), bool)
        for g, members in enumerate(self.members):
            at = np.flatnonzero(reached(rows, lower[rows, g]))
            opened[at, g] = True
            r = rows[at]
            for j in members:
                d = self._distances(x[r], j)
                seen[at, j] = d
                nearer = (d < own[r]) | ((d == own[r]) & (j < best[r]))
                own[r] = np.where(nearer, d, own[r])
                best[r] = np.where(nearer, j, best[r])
            upper[r] = np.sqrt(own[r].astype(float))
        # a group that stayed shut keeps its bound; what is known of the old centroid may be less
        lower[rows] = np.where(opened, 0, lower[rows])
        known = self._bounds(seen, best[rows])
        lower[rows] = np.where(opened, known, np.minimum(lower[rows], known))
        return best, own, upper, lower


STATE = "vec_id long, vector array<long>, cluster int, distance long, upper double, lower array<double>"


def _assign(df: DataFrame, step: Yinyang, width: int, first: bool, moved: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = as_matrix(b["vector"], width)
            if 4 * width * int(np.abs(x).max(initial=0)) ** 2 >= 2**62:
                raise OverflowError("a squared distance of these vectors does not fit a long")
            if first:
                found = step.first(x)
            else:
                found = step.again(x, *(b[c].to_numpy(zero_copy_only=False) for c in ("cluster", "distance", "upper")), as_matrix(b["lower"], len(step.members), float))
            cluster, distance, upper, lower = found
            if moved:  # the distances of the last assignment are results
                distance = ((x - step.centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper), as_lists(lower)], names=["vec_id", "vector", "cluster", "distance", "upper", "lower"])

    return map_rows(df, run, STATE)


def _new_centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster; an empty one stays. Sums are whole numbers and divided on the driver, k rows in all."""
    out = old.copy()
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("vector")[i]).alias(f"s{i}") for i in range(old.shape[1])])
    for r in sums.collect():
        out[r[0]] = [s // r[1] for s in r[2:]]
    return out


def cluster_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, watch: Callable | None = None
) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): (vec_id, vector, cluster, distance) of every kept vector after so many rounds, and the final centroids.

    Kept are the vectors with ``dimensions`` components, none null, infinite or not
    a number, as floor(scale * x). The first centroids are those with the least
    sha256 of ``seed:id``; rows without an id come last there, equal ids go by
    vector. Fewer vectors than ``clusters`` give as many centroids as there
    are; no vector gives no row and no centroid. Rows are never merged: repeated
    ones are clustered each, and other columns are not read. Components whose
    squared distances could exceed a long raise OverflowError. ``watch`` sees
    (round, state) before the state is used.
    """
    kept = is_finite(vector_col) & (F.size(vector_col) == dimensions)
    rows = embeddings.filter(kept).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(vector_col, scale).alias("vector"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = [r.vector for r in rows.orderBy(digest.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()]
    if not start:
        empty = rows.sparkSession.createDataFrame([], STATE)
        return empty.select("vec_id", "vector", "cluster", "distance"), []
    centroids = np.array(start, np.int64)
    group = group_centroids(centroids)
    state, before = rows, None
    for k in range(rounds + 1):
        step = Yinyang(centroids, group, before)
        new = cut(_assign(state, step, dimensions, k == 0, k == rounds))
        if k:
            drop_table(state)
        state = new
        if watch:
            watch(k, state)
        if k < rounds:
            before, centroids = centroids, _new_centroids(state, centroids)
    return state.select("vec_id", "vector", "cluster", "distance"), centroids.tolist()


def report(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and the digest of its centroid."""
    spark = rows.sparkSession
    found = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(found.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by = spark.createDataFrame([(j, s, total, digest[j]) for j, s in found.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Centroid clustering with bounds that are loosened by geometry.

Every vector keeps an upper bound on the distance to its own centroid and a lower bound on that to all others. While the
upper one is smaller, its assignment can't have changed and nothing is worked out. When centroids move, the lower bound of
a vector has to be loosened by what any other centroid can have come closer to it. The plain answer is the full drift of the
fastest centroid. Here the sphere around a cluster (its centroid and the largest upper bound of its vectors) is set against
each moved centroid in the plane through the sphere's centre and the line of the move: the difference of the distances to the
old and the new place grows along the move and shrinks across it, so its largest value in the sphere lies on the arc
that faces the move, and is bounded arc piece by arc piece. A centroid that moves away, or past a far sphere, loosens
little or nothing. Vectors that stay ambiguous are compared with all centroids in whole numbers.

The state of a round is one table of the vectors with their bounds, read and written by tasks on their own; the driver sees sums,
counts and radii of the clusters only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.session import drop_stage, scratch_path, write_stage

# Beyond this a squared distance of whole numbers would not fit in 64 bits; such vectors have no cluster.
LARGEST = 1 << 27
# Up to this, sums of products of 64 components are exact in double precision.
EXACT_DOUBLE = 1 << 22
ARC_PIECES = 32
# Bounds are compared with this relative and absolute room for rounding.
ROOM = 1e-9
BLOCK_ROWS = 4096
STATE = "vec_id long, point array<int>, cluster int, upper double, lower double, n_scans int"


def whole_points(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, point): the vectors with exactly ``dimensions`` finite components, each component as floor(scale * x)."""
    wide = F.col("embedding").cast("array<double>")
    usable = (F.size(wide) == dimensions) & F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST / scale), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, wide).alias("wide")).where("wide IS NOT NULL")
    return rows.select("vec_id", F.transform("wide", lambda x: F.floor(x * scale).cast("int")).alias("point"))


def first_centroids(points: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` points with the smallest SHA-256 of ``prefix`` and id, in that order; equal ids go by their components."""
    name = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(name.asc_nulls_last(), "point").limit(k).collect()
    return np.array([row["point"] for row in rows], dtype=np.int64)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact: by a matrix product where doubles hold all sums, else in 64-bit numbers."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_DOUBLE:
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: how much closer centroid ``j`` can have come to any point within ``radius[i]`` of old centroid ``i``.

    In the plane the old and new place of ``j`` are (-h, 0) and (h, 0), the sphere is a disc around (along, across). The difference of
    the distances to both places grows with the first coordinate and, where that is positive, falls with the second.
    So in each piece of the arc that faces the move, a corner with the largest first and the smallest second coordinate bounds it.
    """
    move = (new - old).astype(np.float64)
    h = np.sqrt((move**2).sum(axis=1)) / 2
    unit = move / np.maximum(2 * h, 1e-300)[:, None]
    offset = old[:, None, :].astype(np.float64) - (old + move / 2)[None, :, :]
    along = (offset * unit[None]).sum(axis=2)
    across = np.sqrt(np.maximum((offset**2).sum(axis=2) - along**2, 0.0))
    turns = np.linspace(0.0, np.pi / 2, ARC_PIECES + 1)
    r = radius[:, None]
    most = np.zeros_like(along)
    for first, last in zip(turns[:-1], turns[1:]):
        z, rho = along + r * np.cos(first), np.maximum(across - r * np.sin(last), 0.0)
        gain = np.sqrt((z + h) ** 2 + rho**2) - np.sqrt((z - h) ** 2 + rho**2)
        most = np.maximum(most, np.where(z > 0, gain, 0.0))
    return np.minimum(most, 2 * h)


class Bounds:
    """What a round needs: the centroids, how far each moved, and by cluster the loosening and half the way to the next centroid."""

    def __init__(self, centroids: np.ndarray, old: np.ndarray | None = None, radius: np.ndarray | None = None) -> None:
        self.centroids = centroids
        k = len(centroids)
        between = np.sqrt(squared_distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(axis=1, initial=np.inf) / 2
        self.drift, self.loosen = np.zeros(k), np.zeros(k)
        if old is not None:
            self.drift = np.sqrt(((centroids - old).astype(np.float64) ** 2).sum(axis=1))
            closer = loosening(old, centroids, radius)
            np.fill_diagonal(closer, 0.0)
            self.loosen = closer.max(axis=1, initial=0.0)

    def assign(self, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Brings cluster and bounds up to date in place; gives the rows that were compared with all centroids."""
        upper[known] += self.drift[cluster[known]]
        lower[known] = np.maximum(lower[known] - self.loosen[cluster[known]], 0.0)
        open_ = np.ones(len(points), dtype=bool)
        for exact in (False, True):
            rows = np.flatnonzero(open_ & known)
            own = cluster[rows]
            if exact:
                upper[rows] = np.sqrt(((points[rows] - self.centroids[own]) ** 2).sum(axis=1).astype(np.float64))
            sure = upper[rows] * (1 + ROOM) + ROOM < np.maximum(lower[rows], self.half[own]) * (1 - ROOM) - ROOM
            open_[rows[sure]] = False
        rows = np.flatnonzero(open_)
        for at in range(0, len(rows), BLOCK_ROWS):
            part = rows[at : at + BLOCK_ROWS]
            distances = squared_distances(points[part], self.centroids)
            nearest = distances.argmin(axis=1)  # the first of equals
            inside = np.arange(len(part))
            cluster[part], upper[part] = nearest, np.sqrt(distances[inside, nearest].astype(np.float64))
            others = distances.astype(np.float64)
            others[inside, nearest] = np.inf
            lower[part] = np.sqrt(others.min(axis=1))
        return open_


def assigned(state: DataFrame, bounds: Bounds, dimensions: int, last: bool) -> DataFrame:
    """``state`` after one assignment; ``last`` adds the exact squared distance in the place of the bounds."""
    shared = state.sparkSession.sparkContext.broadcast(bounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column(1).flatten().to_numpy().reshape(-1, dimensions).astype(np.int64)
            known = ~np.array(batch.column(2).is_null())
            cluster = batch.column(2).fill_null(0).to_numpy().astype(np.int64)
            upper, lower = (batch.column(i).fill_null(0.0).to_numpy().copy() for i in (3, 4))
            scanned = held.assign(points, cluster, upper, lower, known)
            n_scans = pa.array(batch.column(5).to_numpy() + scanned, pa.int32())
            named = pa.array(cluster, pa.int32())
            if last:
                distance = ((points - held.centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(distance), n_scans], ["vec_id", "cluster", "distance", "n_scans"])
            else:
                columns = [batch.column(0), batch.column(1), named, pa.array(upper), pa.array(lower), n_scans]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "point", "cluster", "upper", "lower", "n_scans"])

    return state.mapInArrow(assign, "vec_id long, cluster int, distance long, n_scans int" if last else STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next centroids, floor(sum / count) by component, and the radius of each cluster around the present one.

    One row per cluster comes to the driver. An empty cluster keeps its centroid.
    """
    dimensions = centroids.shape[1]
    sums = F.array(*[F.sum(F.get("point", F.lit(i)).cast("long")) for i in range(dimensions)])
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), sums.alias("sums")).collect()
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for row in rows:
        new[row["cluster"]] = [total // row["n"] for total in row["sums"]]
        radius[row["cluster"]] = row["radius"]
    return new, radius * (1 + ROOM) + ROOM


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, prefix: str = "2:",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_scans): one row per vector that is kept.

    Vectors (vec_id, embedding) are kept if they have exactly ``dimensions`` components, none null or non-finite and none of
    2**27 / ``scale`` or more, where squared distances would leave 64 bits. Centroids start as the ``k`` of smallest SHA-256 of
    ``prefix`` and id (a null id is last), fewer if there are fewer vectors. ``rounds`` times all are assigned to the nearest centroid
    (ties: the smaller number) and centroids move to the floor of the mean; then all are assigned once more. Repeated
    rows count each. ``n_scans`` says how many of the ``rounds + 1`` assignments compared the vector with all centroids. No kept
    vector gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    points = whole_points(vectors, dimensions, scale)
    path = scratch_path(spark, "points")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("upper", "double"), ("lower", "double"))]
    state = write_stage(points.select("vec_id", "point", *nothing, F.lit(0).alias("n_scans")), "points", path)
    centroids = first_centroids(state, k, prefix)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_scans int")
    bounds = Bounds(centroids)
    for _ in range(rounds):
        older, path = path, scratch_path(spark, "assigned")
        state = write_stage(assigned(state, bounds, dimensions, last=False), "assigned", path)
        drop_stage(spark, older)
        new, radius = moved(state, centroids)
        bounds, centroids = Bounds(new, centroids, radius), new
    final = write_stage(assigned(state, bounds, dimensions, last=True), "clusters")
    drop_stage(spark, path)
    totals = {row["cluster"]: row["inertia"] for row in final.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, total, sum(totals.values()), names[i]) for i, total in totals.items()]
    clusters = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    joined = final.join(clusters, "cluster")  # at most k rows on this side
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_scans")

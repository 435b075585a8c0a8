"""Centroid clustering with bounds that are loosened by geometry.

Every vector remembers its cluster, an upper bound of the distance to its centroid and a lower bound of the
distance to all others.  When the centroids have moved, the upper bound grows by the way of the own centroid.
The lower bound shrinks by less than the way of the others: the members of a cluster lie in a sphere around
its old centroid, and in the plane through that centre and both places of a moved centroid the points that
came nearer by 2a lie inside a hyperbola, hence inside the cone of its asymptotes.  A sphere that the cone of
half angle phi just misses therefore loses ``drift * cos(phi)`` at most.  A vector whose bounds still tell the
clusters apart keeps its cluster unseen; an ambiguous one is compared with its own centroid, and if that does
not settle it, with all.  All distances and sums that decide are exact integers.

Only k centroids and their sums (k x dims numbers) come to the driver; the vectors and their bounds are a table
in the shared folder, written once per round, so a lost executor repeats its own files only.

Defined cases: vectors that are null, of another length, or that hold a null or non-finite component take no part;
repeated rows are vectors of their own; equally near centroids go to the smaller number; fewer vectors than ``k``
give as many centroids; an empty centroid stays where it is; a null id is drawn by the word ``null``; an empty
table gives an empty result.  Columns other than the two named ones, whatever their names, are not read.  A
component that is beyond 2**27 after scaling raises, since its squared distance might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.staging import discard, materialize

#: Largest component after scaling, and the largest whose products are exact in doubles.
LARGEST, EXACT = 1 << 27, 1 << 21
#: Relative slack of a comparison of bounds, far above the rounding of doubles.
SLACK = 1e-9
#: Vectors compared with all centroids at a time.
BLOCK = 4096


@dataclass
class Model:
    """Centroids of a round, and what their move from the round before does to the bounds of each cluster."""

    centroids: np.ndarray  # k x dims, long
    drift: np.ndarray | None = None  # way of each centroid
    loosen: np.ndarray | None = None  # the most by which a member's distance to any other centroid shrank

    def apart(self) -> np.ndarray:
        """Half the distance of each centroid to the nearest other one."""
        gaps = np.sqrt(squared(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        return gaps.min(axis=1) / 2


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` to all of ``c``."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For spheres around the old centroids: the most by which a point's distance to each moved centroid can shrink.

    Row i, column j: sphere of cluster i against the move of centroid j, at most the drift of j.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    axis = (new - old) / np.where(drift > 0, drift, 1)[:, None]
    out = np.empty((len(old), len(old)))
    for i, (centre, r) in enumerate(zip(old, radius, strict=True)):
        away = centre - (old + new) / 2
        far = np.sqrt((away * away).sum(axis=1))
        outside = far > r
        safe = np.where(outside, far, 1.0)
        angle = np.arccos(np.clip((away * axis).sum(axis=1) / safe, -1, 1)) - np.arcsin(np.clip(np.where(outside, r, 0.0) / safe, 0, 1))
        out[i] = np.where(outside & (angle > 0), drift * np.clip(np.cos(angle), 0, 1), drift)
    return out


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Model:
    """The model after the centroids went from ``old`` to ``new``; ``radius`` covers the members of each cluster."""
    loss = loosening(old, new, radius * (1 + SLACK) + SLACK)
    np.fill_diagonal(loss, 0.0)
    drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    return Model(new, drift, loss.max(axis=1, initial=0.0))


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, whether all centroids were compared) of a block of vectors."""
    cluster, scanned = cluster.copy(), np.ones(len(v), dtype=bool)
    if model.drift is not None:
        upper, lower = upper + model.drift[cluster], lower - model.loosen[cluster]
        floor = np.maximum(lower, model.apart()[cluster])
        open_ = np.flatnonzero(upper * (1 + SLACK) + SLACK >= floor)
        own = (v[open_] - model.centroids[cluster[open_]]).astype(np.int64)
        upper[open_] = np.sqrt((own * own).sum(axis=1).astype(np.float64))
        scanned[:] = False
        scanned[open_] = upper[open_] * (1 + SLACK) + SLACK >= floor[open_]
    else:
        upper, lower = upper.copy(), lower.copy()
    todo = np.flatnonzero(scanned)
    for at in range(0, len(todo), BLOCK):
        rows = todo[at : at + BLOCK]
        d = squared(v[rows], model.centroids)
        best = d.argmin(axis=1)  # the first of equally near ones
        cluster[rows], upper[rows] = best, np.sqrt(d[np.arange(len(rows)), best].astype(np.float64))
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.inf
    return cluster, upper, lower, scanned


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


_STATE = "vec_id long, v array<int>, before int, cluster int, upper double, lower double, scans int, distance long"


def _assigned(rows: DataFrame, model: Model, dims: int, last: bool) -> DataFrame:
    """The table with the clusters and bounds of a round; the last one also gets the exact distances."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            before, upper, lower, scans = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6))
            cluster, upper, lower, scanned = assign(v, before, upper, lower, model)
            distance = ((v - model.centroids[cluster]) ** 2).sum(axis=1) if last else np.zeros(len(v), dtype=np.int64)
            cols = [batch.column(0), batch.column(1), pa.array(before, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans + scanned, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "before", "cluster", "upper", "lower", "scans", "distance"])

    return rows.mapInArrow(work, _STATE)


def _changes(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Per cluster: change of its count, changes of its sums, radius of its sphere; only rows that moved add to the sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, radius = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64), np.zeros(k)
        for batch in batches:
            before, cluster, upper = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            np.maximum.at(radius, cluster, upper)
            gone = np.flatnonzero(before != cluster)
            v = _matrix(batch.column(0).take(pa.array(gone)), dims)
            for sign, side in ((1, cluster[gone]), (-1, before[gone])):
                for c in np.unique(side[side >= 0]):
                    here = side == c
                    n[c] += sign * here.sum()
                    sums[c] += sign * v[here].sum(axis=0)
        cols = [pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(radius)]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "sums", "radius"])

    parts = rows.select("v", "before", "cluster", "upper").mapInArrow(partial, "cluster int, n long, sums array<long>, radius double")
    each = parts.select("cluster", "n", "radius", F.posexplode("sums").alias("pos", "x"))
    n, sums, radius = np.zeros(k, dtype=np.int64), [[0] * dims for _ in range(k)], np.zeros(k)
    # k * dims rows, whatever the number of vectors.
    for r in each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("radius").alias("radius")).collect():
        n[r["cluster"]], sums[r["cluster"]][r["pos"]], radius[r["cluster"]] = r["n"], r["x"], r["radius"]
    return n, sums, radius


def usable_vectors(df: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """``(vec_id, v)``: vectors of ``dims`` finite components as ``floor(scale * x)``."""

    def scaled(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).cast("int")

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("_x")).where(F.coalesce(F.size("_x") == dims, F.lit(False)))
    finite = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(finite).select("vec_id", F.transform("_x", scaled).alias("v"))


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans)`` per usable vector.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id`` and move to the floored
    means ``rounds`` times.  ``scans`` counts how often a vector was compared with all centroids (1 to rounds + 1).
    """
    spark = df.sparkSession
    rows = usable_vectors(df, vec_id, embedding, dims, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    start = [r["v"] for r in rows.orderBy(drawn, "v").limit(k).collect()]
    k = len(start)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    if not k:
        return spark.createDataFrame([], schema)
    state = rows.select("vec_id", "v", F.lit(-1).alias("before"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans"), F.lit(0).cast("long").alias("distance"))
    model, counts, sums = Model(np.array(start, dtype=np.int64)), np.zeros(k, dtype=np.int64), [[0] * dims for _ in range(k)]
    for turn in range(rounds + 1):
        after = materialize(_assigned(state, model, dims, turn == rounds), "clusters")
        discard(state)
        state = after
        if turn < rounds:
            n, more, radius = _changes(state, k, dims)
            counts += n
            sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, more, strict=True)]
            means = [[s // int(c) for s in x] if c else list(map(int, old)) for x, c, old in zip(sums, counts, model.centroids, strict=True)]
            model = moved(model.centroids, np.array(means, dtype=np.int64), radius)
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(model.centroids)]
    small = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("vec_id", "cluster", "distance", "scans").join(F.broadcast(small), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")

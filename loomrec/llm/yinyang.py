"""Exact k-means over integer vectors by Yinyang grouping: centroid groups fixed once, a lower bound per group and vector, a global
filter, a group filter, and exact distances for the centroids that survive both."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import drop_stored, stored

SCALE = 1024
#: Components saturate here, so that squared distances of 64 components fit a long.
MOST = 1 << 27
#: Below this magnitude a float64 product of 64 components is an exact integer.
EXACT = 1 << 20
#: Centroids per group, about.
PER_GROUP = 4
#: Bounds are kept on the safe side of rounding by this share.
SLACK = 1e-9


@dataclass(frozen=True)
class Model:
    """Centroids (k, d), the group of each, and how far each moved since the bounds were taken."""

    centroids: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups.max()) + 1 if len(self.groups) else 0


def quantised(x: Column) -> Column:
    """floor(1024 * x) of every component, saturated at +-2^27."""
    return F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))


def usable(x: Column, dims: int) -> Column:
    """True for vectors of exactly ``dims`` components, none null, NaN or infinite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) == dims) & ~bad


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of integer rows."""
    if len(q) and max(np.abs(q).max(), np.abs(c).max()) <= EXACT:
        a, b = q.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    for j, row in enumerate(c):
        diff = q - row
        out[:, j] = (diff * diff).sum(1)
    return out


def squared_pairs(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``q`` from the same row of ``c``."""
    diff = q - c
    return (diff * diff).sum(1)


def group_centroids(c: np.ndarray) -> np.ndarray:
    """Group of each centroid, from a few rounds of k-means over the centroids themselves; made once, before the first round."""
    t = max(1, len(c) // PER_GROUP)
    seeds, far = [0], squared(c, c[:1])[:, 0]
    for _ in range(t - 1):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, squared(c, c[seeds[-1:]])[:, 0])
    means = c[seeds].astype(np.float64)
    for _ in range(5):
        own = ((c[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([c[own == g].mean(0) if (own == g).any() else means[g] for g in range(t)])
    return np.unique(own, return_inverse=True)[1]


def first_bounds(q: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower per group) by distances to all centroids. The lower bound leaves the own centroid out."""
    d = squared(q, model.centroids)
    cluster = d.argmin(1)  # the first of equal minima has the smaller number
    root = np.sqrt(d.astype(np.float64))
    rows = np.arange(len(q))
    upper = root[rows, cluster] * (1 + SLACK)
    root[rows, cluster] = np.inf
    lower = np.stack([root[:, model.groups == g].min(1) for g in range(model.n_groups)], 1) * (1 - SLACK)
    return cluster, upper, lower


def next_bounds(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and clusters after the centroids moved.

    Global filter: a vector whose upper bound is below every group's lower bound keeps its cluster; the upper bound is made
    exact once before it counts as failed. Group filter: groups whose lower bound lies above the upper bound are passed over.
    In the others a centroid survives unless the old bound less its own drift exceeds the upper bound; survivors are measured.
    """
    groups, drift = model.groups, model.drift
    furthest = np.array([drift[groups == g].max() for g in range(model.n_groups)])
    cluster, upper, before = cluster.copy(), upper + drift[cluster], lower
    lower = before - furthest
    open_ = np.flatnonzero(upper >= lower.min(1))
    own = squared_pairs(q[open_], model.centroids[cluster[open_]])
    upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    still = upper[open_] >= lower[open_].min(1)
    open_, own = open_[still], own[still]
    if not len(open_):
        return cluster, upper, lower
    mine = cluster[open_]
    bound = before[open_][:, groups] - drift  # no centroid but the own one is nearer than this
    best, where = own.copy(), mine.copy()
    reach = upper[open_]
    for j in range(len(groups)):
        near = np.flatnonzero((lower[open_, groups[j]] <= reach) & (bound[:, j] <= reach) & (mine != j))
        if len(near):
            d = squared_pairs(q[open_[near]], model.centroids[j])
            bound[near, j] = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
            better = (d < best[near]) | ((d == best[near]) & (j < where[near]))
            best[near[better]], where[near[better]] = d[better], j
    rows = np.arange(len(open_))
    bound[rows, mine] = np.sqrt(own.astype(np.float64)) * (1 - SLACK)
    bound[rows, where] = np.inf
    cluster[open_], upper[open_] = where, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    lower[open_] = np.stack([bound[:, groups == g].min(1) for g in range(model.n_groups)], 1)
    return cluster, upper, lower


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from a matrix, without a Python object per row."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def assigned(state: DataFrame, model: Model, dims: int) -> DataFrame:
    """(vec_id, q, was, cluster, upper, lower) after one assignment; ``was`` is null in the first. Map only, no shuffle."""
    first = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("q"), dims, np.int64)
            if first:
                was = pa.nulls(len(q), pa.int32())
                cluster, upper, lower = first_bounds(q, model)
            else:
                was = batch.column("cluster")
                cluster, upper, lower = next_bounds(
                    q, was.to_numpy().astype(np.int64), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), model.n_groups, np.float64), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), was, pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64())],
                names=["vec_id", "q", "was", "cluster", "upper", "lower"])

    return state.mapInArrow(run, "vec_id long, q array<int>, was int, cluster int, upper double, lower array<double>")


def moved_sums(state: DataFrame, dims: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Changes of the row count and component sums of each cluster by the vectors that changed theirs: at most k rows of d + 2
    numbers reach the driver, after a partial aggregation in every task."""
    moved = state.filter("was is null or was != cluster")
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))
    long = moved.select("q", F.explode(sides).alias("x")).filter("x.c is not null").select(F.col("x.c").alias("c"), F.col("x.s").alias("s"), "q")
    sums = long.groupBy("c").agg(F.sum("s").alias("n"), *[F.sum(F.col("s") * F.col("q")[i].cast("long")).alias(f"d{i}") for i in range(dims)])
    rows = sums.collect()
    return {r["c"]: r["n"] for r in rows}, {r["c"]: [r[f"d{i}"] for i in range(dims)] for r in rows}


def initial_centroids(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; a null id counts as the empty text, ties go to the smaller
    vector. Fewer vectors, fewer centroids."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64).reshape(len(rows), dims)


def fit(vectors: DataFrame, k: int, rounds: int, seed: int, dims: int) -> tuple[DataFrame, Model]:
    """(vec_id, q, cluster, ...) of the last assignment and its model. ``vectors``: (vec_id, q), a stored table.

    Each round is one map over a table in the shared folder that carries every vector's bounds, so a lost executor costs its own
    tasks only. Centroids are exact integers: sums change by the vectors that moved. Rounds end early once none moved, as all
    later ones would change nothing.
    """
    c = initial_centroids(vectors, k, seed, dims)
    model = Model(c, group_centroids(c) if len(c) else np.zeros(0, np.int64), np.zeros(len(c)))
    if not len(c):
        return vectors.selectExpr("vec_id", "q", "0 AS cluster"), model
    counts, sums = [0] * len(c), [[0] * dims for _ in c]
    state = stored(assigned(vectors, model, dims), "clusters")
    for _ in range(rounds):
        n, changes = moved_sums(state, dims)
        if not n:
            break
        for j, change in changes.items():
            counts[j] += n[j]
            sums[j] = [a + b for a, b in zip(sums[j], change)]
        c = np.array([[s // counts[j] for s in sums[j]] if counts[j] else model.centroids[j].tolist() for j in range(len(c))], np.int64)
        drift = np.sqrt(squared_pairs(c, model.centroids).astype(np.float64)) * (1 + SLACK)
        model = Model(c, model.groups, drift)
        following = stored(assigned(state, model, dims), "clusters")
        drop_stored(state)
        state = following
    return state, model


def cluster_digest(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector.

    vectors: (vec_id long, embedding array). Null vectors, vectors of other sizes and those with a null, NaN or infinite
    component are left out. A null vec_id stays a row. Repeated rows each count and are each returned. Equal distances go to the
    smaller cluster number; a cluster without vectors keeps its centroid. With fewer than k vectors there are fewer clusters; no
    vector, no rows. Components beyond 2^17 saturate. Further columns are dropped.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    kept = stored(vectors.filter(usable(x, dims)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(x).alias("q")), "vectors")
    state, model = fit(kept, k, rounds, seed, dims)
    drop_stored(kept)
    centroids = spark.createDataFrame(
        [(j, [int(v) for v in c], hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()) for j, c in enumerate(model.centroids)],
        "cluster int, c array<int>, centroid_sha256 string")
    gap = F.zip_with("q", "c", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    measured = state.join(F.broadcast(centroids), "cluster").select(  # k rows
        "vec_id", "cluster", F.aggregate(gap, F.lit(0).cast("long"), lambda a, v: a + v).alias("distance"), "centroid_sha256")
    sums = measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # at most k rows
    total = sum(r["s"] for r in sums)
    inertia = spark.createDataFrame([(r["cluster"], r["s"], total) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return measured.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

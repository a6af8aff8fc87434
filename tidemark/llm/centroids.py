"""Exact k-means of integer vectors with Hamerly's bounds.

Each vector carries one upper bound of the distance to its own centroid and one lower bound of that to the second nearest.
A round loosens them by the centroids' drift; where the upper bound stays below the lower one, or below half of the way to
the next centroid, the vector keeps its centroid without a look at the others. The rest get their own distance, and, if that
does not settle it, a scan of all centroids in exact integers. The state of a round (vector, cluster, bounds) is a written table that
the next round reads in place of the one before; vectors are never shuffled. Centroids follow from exact sums, which a
round changes by the vectors that moved; they are the only thing that the driver sees.

Bounds are floating-point numbers, each step rounded outwards by more than its error, so that they stay bounds.

Nulls and lengths: a vector that is null, has another number of components, or a null or non-finite one, has no row. A null
id is an id; it never gives a first centroid while others are there. Ties go to the smaller centroid number. Repeated rows are vectors each;
those of one id stand in the order of their components as first centroids. Fewer vectors than centroids give so many centroids. An
empty table has no rows. Components of any size are exact; a distance or a sum of them that no long holds is null.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lasting, release

#: Components of up to so much are scanned in 64-bit integers: 64 squared differences still fit. Larger ones are Python integers.
PLAIN = 1 << 26
_OUT, _IN = 1 + 2.0**-40, 1 - 2.0**-40
_LONG = (1 << 63) - 1


def prepared(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, vector) of the vectors that are kept, with floor(scale * x) of each component, a whole number in a double."""
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), size))
            if batch.num_rows:
                x = np.floor(_matrix(batch.column(1), size) * scale)
                fine = np.isfinite(x).all(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), _lists(x[fine])], ["id", "vector"])

    return bounded_batches(chosen).mapInArrow(run, chosen.schema)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # a null becomes NaN


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)), pa.array(x.ravel()))


def whole(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as arrays of integers in which squared distances are exact."""
    largest = max((abs(v) for c in centroids for v in c), default=0)
    if largest < PLAIN and (not x.size or np.abs(x).max() < PLAIN) and x.shape[1] <= 64:
        return x.astype(np.int64), np.array(centroids, dtype=np.int64)
    as_ints = lambda rows: np.array([[int(v) for v in r] for r in rows], dtype=object).reshape(len(rows), x.shape[1])
    return as_ints(x), as_ints(centroids)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def _roots(squares: np.ndarray, by: float) -> np.ndarray:
    return np.array([math.sqrt(v) for v in squares], dtype=np.float64) * by if squares.dtype == object else np.sqrt(squares.astype(np.float64)) * by


class Drift:
    """How far the centroids moved, and how far they are apart; each number rounded to the side that keeps bounds right."""

    def __init__(self, before: list[list[int]], now: list[list[int]]):
        k, apart = len(now), lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
        moved = [apart(a, b) * _OUT for a, b in zip(before, now, strict=True)]
        self.own = np.array(moved)
        self.others = np.array([max((moved[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        self.half = np.array([min((apart(now[i], now[j]) * _IN / 2 for j in range(k) if j != i), default=math.inf) for i in range(k)])


def assign(x: np.ndarray, centroids: list[list[int]], cluster=None, upper=None, lower=None, drift: Drift | None = None):
    """(cluster, upper, lower, scanned): the nearest centroid of each vector, new bounds, and which vectors were scanned in full.

    Without bounds, all are.
    """
    ints, cs = whole(x, centroids)
    if drift is None:
        cluster, upper, lower = np.zeros(len(x), dtype=np.int32), np.zeros(len(x)), np.zeros(len(x))
        scan = np.arange(len(x))
    else:
        cluster = cluster.copy()
        upper, lower = (upper + drift.own[cluster]) * _OUT, lower - drift.others[cluster] * _OUT
        lower = np.where(lower > 0, lower * _IN, lower * _OUT)
        safe = np.maximum(lower, drift.half[cluster])
        open_ = np.flatnonzero(~(upper < safe))
        upper[open_] = _roots(squared(ints[open_], cs[cluster[open_]]), _OUT)
        scan = open_[~(upper[open_] < safe[open_])]
    if len(scan):
        all_ = np.stack([squared(ints[scan], c) for c in cs], axis=1)
        near = all_.argmin(axis=1)  # of equal ones the first
        at = np.arange(len(scan))
        cluster[scan], upper[scan] = near, _roots(all_[at, near], _OUT)
        if len(centroids) > 1:
            rest = all_.astype(object) if all_.dtype == object else all_.copy()
            rest[at, near] = rest.max() + 1
            lower[scan] = _roots(rest.min(axis=1), _IN)
        else:
            lower[scan] = math.inf
    return cluster, upper, lower, scan


def _round(state: DataFrame, size: int, centroids: list[list[int]], drift: Drift | None) -> DataFrame:
    """state (id, vector, cluster, upper, lower) after one assignment, with the cluster before."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), size)
            known = () if drift is None else [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
            cluster, upper, lower, _ = assign(x, centroids, *known, **({} if drift is None else {"drift": drift}))
            before = np.full(len(x), -1, dtype=np.int32) if drift is None else known[0]
            columns = [batch.column(0), batch.column(1), *map(pa.array, (cluster, upper, lower, before))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "cluster", "upper", "lower", "before"])

    kind = state.select("id", "vector").schema.add("cluster", "integer").add("upper", "double").add("lower", "double").add("before", "integer")
    return bounded_batches(state).mapInArrow(run, kind)


def _moves(state: DataFrame, size: int, k: int) -> DataFrame:
    """(cluster, place, total): what the vectors that changed their cluster add to its sums (place from 0) and count (-1); exact."""

    def run(batches):
        sums = np.array([[0] * (size + 1) for _ in range(k)], dtype=object)
        for batch in batches:
            x, _ = whole(_matrix(batch.column(1), size), [])
            both = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
            for column, sign in ((2, 1), (3, -1)):
                of = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(of[of >= 0]):
                    sums[c] += sign * both[of == c].sum(axis=0).astype(object)
        rows = [(c, p if p < size else -1, Decimal(int(v))) for c, row in enumerate(sums) for p, v in enumerate(row) if v]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.decimal128(38, 0)), strict=True)], ["cluster", "place", "total"])

    moved = bounded_batches(state.where("cluster <> before").select("id", "vector", "cluster", "before"))
    return moved.mapInArrow(run, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))


def _first(kept: DataFrame, k: int, order: Column) -> list[list[int]]:
    rows = kept.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    return [[int(v) for v in r.vector] for r in rows]


def cluster(vectors: DataFrame, order: Column, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, cluster, distance, cluster_inertia, inertia, centroid) of each vector that is kept.

    order: an expression of `id` by which the first k vectors are the first centroids. distance is squared.
    """
    kept = lasting(prepared(vectors, id_col, vector_col, size, scale))
    centroids = _first(kept, k, order)
    sums, counts, drift, state = [[0] * size for _ in centroids], [0] * len(centroids), None, kept
    for _ in range(rounds if centroids else 0):
        after = lasting(_round(state, size, centroids, drift))
        release(state)
        state, moved = after, _moves(after, size, len(centroids)).collect()  # at most k * (size + 1) numbers
        for r in moved:
            if r.place < 0:
                counts[r.cluster] += int(r.total)
            else:
                sums[r.cluster][r.place] += int(r.total)
        if not moved and drift is not None and not drift.own.any():  # neither vectors nor centroids moved: nor will they
            break
        now = [[v // n for v in total] if n else c for total, n, c in zip(sums, counts, centroids, strict=True)]
        centroids, drift = now, Drift(centroids, now)
    last = lasting(_last(state, size, centroids, drift))
    release(state)
    return last.join(F.broadcast(_told(last, centroids)), "cluster")  # a row per centroid


def _last(state: DataFrame, size: int, centroids: list[list[int]], drift: Drift | None) -> DataFrame:
    """(id, vector, cluster, distance) after the last assignment."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), size)
            known = () if drift is None else [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
            found = assign(x, centroids, *known, **({} if drift is None else {"drift": drift}))[0]
            ints, cs = whole(x, centroids)
            distance = [int(v) if v <= _LONG else None for v in squared(ints, cs[found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.astype(np.int32)), pa.array(distance, pa.int64())], ["id", "vector", "cluster", "distance"])

    kind = state.select("id", "vector").schema.add("cluster", "integer").add("distance", "long")
    return bounded_batches(state).mapInArrow(run, kind)


def _told(last: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, centroid, cluster_inertia, inertia) of each centroid."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = last.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), total).alias("total")).collect()  # a row per centroid
    by_cluster = {r.cluster: None if r.total is None else int(r.total) for r in found}
    fits = lambda v: v if v is not None and v <= _LONG else None
    whole_ = None if None in by_cluster.values() else sum(by_cluster.values())
    rows = [(i, [str(v) for v in c], fits(by_cluster.get(i, 0)), fits(whole_)) for i, c in enumerate(centroids)]
    return last.sparkSession.createDataFrame(rows, "cluster int, centroid array<string>, cluster_inertia long, inertia long")

"""k-means with bounds against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids
from tidemark.llm.queries import op12_centroids

LONG = 2**63 - 1


def plain(rows, size, k=8, rounds=10):
    """(id, cluster, distance, cluster_inertia, inertia, digest) by full scans."""
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    cs = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x: min(range(len(cs)), key=lambda c: (away(x, cs[c]), c))
    for _ in range(rounds):
        of = [nearest(x) for _, x in kept]
        groups = [[x for (_, x), c in zip(kept, of, strict=True) if c == n] for n in range(len(cs))]
        cs = [[sum(v) // len(g) for v in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    found = [(i, c := nearest(x), away(x, cs[c])) for i, x in kept]
    within = {c: sum(d for _, n, d in found if n == c) for c in range(len(cs))}
    fits = lambda v: v if v <= LONG else None
    if any(d > LONG for _, _, d in found):
        total = {c: None for c in within if any(n == c and d > LONG for _, n, d in found)}
        return sorted([(i, c, fits(d), total.get(c, fits(within[c])), None, hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found], key=str)
    return sorted([(i, c, d, fits(within[c]), fits(sum(within.values())), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found], key=str)


def computed(spark, tmp_path, rows):
    path = tmp_path / "embeddings.parquet"
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("cluster", F.lit(9)).withColumn("vector", F.lit(1))
    table.repartition(3).write.parquet(str(path))
    return sorted((tuple(r) for r in op12_centroids(spark, str(tmp_path)).collect()), key=str)


def single(x):
    return None if x is None else [None if v is None else float(np.float32(v)) for v in x]


def table(n=300):
    r = random.Random(4)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, single([v + r.gauss(0, 0.4) for v in r.choice(middles)])) for i in range(n)]
    rows += [(i, single([0.25] * 64)) for i in range(n, n + 150)]  # a third of all rows are one vector
    rows += [(n + 500, None), (n + 501, []), (n + 502, [1.0] * 63), (n + 503, [1.0] * 65), (n + 504, [float("nan")] + [1.0] * 63), (n + 505, [float("inf")] + [1.0] * 63), (n + 506, [None] + [1.0] * 63)]
    return [*rows, rows[3], rows[3], (3, single([0.5] * 64)), (None, single([0.1] * 64)), (None, single([0.2] * 64))]


def test_rows_of_plain_scans(spark, tmp_path):
    rows = table()
    assert computed(spark, tmp_path, rows) == plain(rows, 64)


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 64)], [(i, [1.0] * 64) for i in range(12)], [(1, [1.0] * 3)]], ids=["none", "one", "all the same", "none kept"])
def test_few_vectors(spark, tmp_path, rows):
    assert computed(spark, tmp_path, rows) == plain(rows, 64)


def test_large_components(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, single([r.choice([1e5, -3e5, 0.1, 7e4]) * r.random() for _ in range(64)])) for i in range(40)]
    assert computed(spark, tmp_path, rows) == plain(rows, 64)
    rows.append((40, single([1e30] * 64)))
    other = tmp_path / "more"
    other.mkdir()
    assert computed(spark, other, rows) == plain(rows, 64)


def test_bounds_hold_and_spare_scans():
    r = np.random.default_rng(7)
    x = np.floor(np.concatenate([r.normal(m, 0.3, (200, 64)) for m in (0, 1, 2, 4, 8)]) * 1024)
    cs = [[int(v) for v in row] for row in x[[0, 200, 400, 600, 800]]]
    state, drift, scans = (), None, []
    for _ in range(6):
        cluster, upper, lower, scanned = centroids.assign(x, cs, *state, drift=drift)
        exact = np.sqrt(np.stack([((x - np.array(c)) ** 2).sum(axis=1) for c in cs], axis=1))
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper >= np.sort(exact, axis=1)[:, 0]).all() and (lower <= np.sort(exact, axis=1)[:, 1]).all()
        scans.append(len(scanned))
        now = [[int(v) for v in np.floor(x[cluster == c].sum(axis=0) / (cluster == c).sum())] for c in range(5)]
        state, drift, cs = (cluster, upper, lower), centroids.Drift(cs, now), now
    assert scans[0] == len(x) and sum(scans[1:]) < len(x)

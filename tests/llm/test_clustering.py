"""Sort-means against plain assignment of every vector to every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from vellum.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, distance long, x int"


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i is None, i or 0, v, *near(v)[::-1]) for i, v in kept)), centroids


def made(seed, n, size, grid):
    """Vectors on a coarse grid, so that many are equally near to several centroids; some broken, some repeated."""
    rng = random.Random(seed)
    value = lambda: rng.choice([-1.0, -0.5, 0.0, 0.5, 0.004]) if grid else rng.gauss(0, 3)
    rows = [(i, [value() for _ in range(size)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (size + 1)), (n + 3, [None, *[0.0] * (size - 1)]), (n + 4, [math.nan] * size), (n + 5, [math.inf] * size), (n + 6, [-math.inf, *[1.0] * (size - 1)])]
    return rows + rows[:3] + [(None, [value() for _ in range(size)]), (3, [value() for _ in range(size)])]


@pytest.mark.parametrize("n, size, k, grid", [(300, 4, 12, True), (300, 2, 40, False), (5, 3, 40, True), (0, 3, 4, False)])
def test_sort_means(spark, n, size, k, grid):
    rows = made(3, n, size, grid)
    frame = spark.createDataFrame([(i, e, 1, "x", "y", 2, 3) for i, e in rows], SCHEMA).repartition(4)
    found, centroids = clustering.cluster(frame, k, 5, size)
    want, final = brute(rows, k, 5, size)
    assert centroids.tolist() == final
    assert sorted((r.vec_id is None, r.vec_id or 0, list(r.v), r.cluster, r.distance) for r in found.collect()) == want


def test_one_vector_many_times(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0], 1, "x", "y", 2, 3) for i in range(200)], SCHEMA)
    found, centroids = clustering.cluster(frame, 3, 5, 2)
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and centroids.tolist() == [[256, 512]] * 3


def test_scan_stops(monkeypatch):
    """Far centroids aren't looked at."""
    rng = np.random.default_rng(1)
    centroids = np.concatenate([rng.integers(0, 10, (10, 3)), rng.integers(9_000, 9_010, (10, 3))])
    v = rng.integers(0, 10, (100, 3))
    means = clustering.SortMeans(centroids)
    looked, plain = [], clustering.squared
    monkeypatch.setattr(clustering, "squared", lambda a, b: (looked.append(len(a)), plain(a, b))[1])
    means.assigned(v, np.zeros(100, np.int64))
    assert sum(looked) <= 100 * 11


def test_empty_and_too_large(spark):
    assert clustering.report(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame([(1, [1e30] * 64, 1, "x", "y", 2, 3)], SCHEMA)
    with pytest.raises(Exception, match="component too large"):
        clustering.report(frame).collect()

"""N-simplex clustering against comparing every vector with every centroid in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from sampleloom.llm import simplex_kmeans as sk

SCHEMA = "vec_id bigint, embedding array<double>, Cluster string, distance double"


def brute(rows, k=16, rounds=3, size=64, scale=64, salt="1"):
    """Clusters, distances and centroids by the contract's words."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))[::-1]
    for _ in range(rounds):
        own = [[v for _, v in kept if assign(v)[0] == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(x) for x in zip(*o)] if o else c for o, c in zip(own, centroids)]
    return sorted(((i, *assign(v)) for i, v in kept), key=str), centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], SCHEMA)


def vectors(n, size=64, seed=1, spread=0.05, groups=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, size))
    return [(i, (middle[i % groups] + spread * rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 2, 16])
def test_equal_to_comparing_all(spark, pivots):
    rows = vectors(150, seed=pivots) + vectors(40, seed=9, spread=3.0)
    found, centroids = sk.cluster(frame(spark, rows), pivots=pivots)
    want, middles = brute(rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert centroids == middles


def test_odd_vectors_take_no_part_and_repeated_ones_count(spark):
    rows = vectors(30, groups=2)
    rows += [(7, rows[3][1])] * 5 + [(None, rows[4][1]), (100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 63 + [None]), (104, [math.nan] + [0.1] * 63), (105, [math.inf] + [0.1] * 63), (106, [0.0] * 64), (106, [-0.01] * 64)]
    found, centroids = sk.cluster(frame(spark, rows), k=8)
    want, middles = brute(rows, k=8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert centroids == middles and found.columns == ["vec_id", "cluster", "distance"]


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(5, None)], [(None, [1.0] * 64)], [(5, [0.5] * 64)], [(i, [0.5] * 64) for i in range(40)], vectors(3)):
        found, _ = sk.cluster(frame(spark, rows))
        want = brute(rows)[0] if any(i is not None for i, _ in rows) else []
        assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        sk.cluster(frame(spark, [(1, [1e30] + [0.0] * 63)]))


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    middle = rng.integers(-200, 200, (12, 64))
    points = np.concatenate([m + rng.integers(-3, 4, (200, 64)) for m in middle])
    projection = sk.Projection(points[::7], 16)
    apexes, others = projection.apexes(points), projection.apexes(middle)
    true = ((points[:, None] - middle) ** 2).sum(2)
    low, high = sk.bounds(apexes, others)
    assert (low <= true).all() and (true <= high).all()
    number, distance, compared = sk.nearest(points, apexes, middle, others)
    assert (number == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert compared < 2 * len(points)  # of 12 for each


def test_ties_go_to_the_smaller_number():
    middle = np.array([[2] * 64, [0] * 64, [0] * 64, [2] * 64])
    points = np.array([[1] * 64, [0] * 64, [3] * 64])
    projection = sk.Projection(np.concatenate([points, middle]), 4)
    number, distance, _ = sk.nearest(points, projection.apexes(points), middle, projection.apexes(middle))
    assert number.tolist() == [0, 1, 0] and distance.tolist() == [64, 0, 64]


def test_query_gives_inertia_and_digests(spark, tmp_path):
    rows = vectors(60)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: r for r in sk.op11_simplex_kmeans(spark, str(tmp_path)).collect()}
    want, centroids = brute(rows)
    for i, c, d in want:
        r = found[i]
        assert (r.cluster, r.distance) == (c, d)
        assert r.cluster_inertia == sum(x[2] for x in want if x[1] == c) and r.inertia == sum(x[2] for x in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()

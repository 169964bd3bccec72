"""Centroid clustering against plain Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from manchete.llm import clustering

from .helpers import clashing

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute(rows, dims, k, rounds):
    kept = [
        (i, [math.floor(Fraction(float(x)) * 256) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "")
    floats = {id(r): v for r, v in zip(kept, [list(map(float, v)) for _, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)], strict=True)}
    centroids = [v for _, v in sorted(kept, key=lambda r: (order(r), floats[id(r)]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    return found, centroids


def check(spark, rows, dims, k, rounds=5, **options):
    df = table(spark, rows)
    got = clustering.cluster_vectors(df, dims=dims, k=k, rounds=rounds, **options).collect()
    wanted, centroids = brute(rows, dims, k, rounds)
    inertia = sum(d for _, d, _ in wanted)
    by = {}
    for _, d, c in wanted:
        by[c] = by.get(c, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    whole = [(i, c, fits(d), fits(by[c]) if all(x < 1 << 63 for _, x, o in wanted if o == c) else None,
              fits(inertia) if all(x < 1 << 63 for _, x, _ in wanted) else None, [str(x) for x in centroids[c]]) for i, d, c in wanted]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, whole))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (12, 8))
    return [(i, (centers[i % 12] + rng.normal(0, 0.2, 8)).tolist()) for i in range(400)]


@pytest.mark.parametrize("share", [0.0, 0.6, 0.9, 1.0])
def test_same_as_plain_integers(spark, clustered, share):
    check(spark, clustered, 8, 10, share=share)


def test_leading_axes_hold_the_share(spark, clustered):
    flat = [(i, [*v[:2], *[0.01 * x for x in v[2:]]]) for i, v in clustered]
    widths = lambda rows, share: clustering.principal_axes(table(spark, rows).withColumnRenamed("embedding", "vector"), 8, share, 256).axes.shape[1]
    assert widths(flat, 0.9) == 2 < widths(clustered, 0.9) < widths(clustered, 1.0) <= 8
    assert widths([(1, [1.0] * 8)] * 3, 0.9) >= 1


def test_unusable_vectors_ties_and_repeats(spark, clustered):
    rng = np.random.default_rng(4)
    grid = [(1000 + i, rng.integers(-2, 3, 8).tolist()) for i in range(120)]  # many equal distances
    odd = [(2000, None), (2001, []), (2002, [0.5] * 7), (2003, [0.5] * 9), (2004, [math.nan] + [0.0] * 7),
           (2005, [math.inf] + [0.0] * 7), (2006, [None] + [0.0] * 7), (None, [0.25] * 8), (2007, [0.0] * 8)]
    check(spark, [*grid, *grid[:30], *odd, (1000, [9.0] * 8)], 8, 10)


def test_components_of_any_size(spark, clustered):
    wide = [(3000, [1e30, -1e30] + [1.0] * 6), (3001, [1e30] * 8), (3002, [1e307] + [0.5] * 7), (3003, [2.0**20] * 8), (3004, [2.0**22] + [0.0] * 7)]
    check(spark, clustered[:60] + wide, 8, 6)
    check(spark, wide, 8, 3)


def test_few_vectors_and_none(spark):
    check(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], 2, 40)
    empty = clustering.cluster_vectors(table(spark, [(1, None)]), dims=2)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert empty.count() == 0


def test_clashing_columns_and_rounds(spark, clustered):
    df = clashing(table(spark, clustered)).selectExpr("*", "0 AS cluster", "0 AS distance", "0 AS vector", "0 AS lead", "0 AS rest")
    got = clustering.cluster_vectors(df, dims=8, k=5, rounds=0).collect()
    found, _ = brute(clustered, 8, 5, 0)
    assert {(r.vec_id, r.cluster, r.distance) for r in got} == {(i, c, d) for i, d, c in found}


def test_bounds_hold_and_leave_out_most_centroids(clustered):
    """No bound exceeds its distance, and well separated centroids are not measured."""
    values = np.array([v for _, v in clustered])
    split = clustering._Split(values, 256)
    x = split.narrow.astype(float)
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = clustering._Axes(x.mean(axis=0), axes[:, ::-1][:, :6])
    centroids = split.narrow[:12].tolist()
    nearest = clustering._Nearest(centroids, axes, 256)
    lead, rest = axes.rotate(x)
    exact = ((split.narrow[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (nearest.bounds(lead, rest) <= exact).all()
    own, distances = nearest.find(split, lead, rest)
    assert (own == exact.argmin(axis=1)).all() and distances == exact.min(axis=1).tolist()
    assert nearest.measured < nearest.pairs / 4
    # A residual norm next to zero is the hardest case of rounding.
    flat = np.zeros((50, 8))
    flat[:, 0] = np.linspace(-1e5, 1e5, 50)
    flat[::2, 1] = 1e-3
    axes = clustering._Axes(np.zeros(8), np.eye(8, 1))
    nearest = clustering._Nearest(clustering._Split(flat[:9], 256).narrow.tolist(), axes, 256)
    split = clustering._Split(flat, 256)
    lead, rest = axes.rotate(split.narrow.astype(float))
    exact = ((split.narrow[:, None, :] - nearest.narrow[None]) ** 2).sum(axis=2)
    assert (nearest.bounds(lead, rest) <= exact).all()


def test_digest(spark):
    df = spark.createDataFrame([(["-1", "20"],)], "centroid array<string>")
    assert df.select(clustering.centroid_digest()).first()[0] == hashlib.sha256(b"-1,20").hexdigest()

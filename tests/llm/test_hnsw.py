"""Nearest neighbours against brute force."""

import math

import numpy as np

from manchete.llm import hnsw
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows if usable(i, v)]
    result = {}
    for q, x in good:
        if q % 100 == 0:
            near = {}
            for i, y in good:
                if i != q and len(y) == len(x):
                    near[i] = min(near.get(i, math.inf), float(np.sqrt(((x - y) ** 2).sum())))
            best = sorted((d, i) for i, d in near.items())[:k]
            result[q] = [(i, d) for d, i in best]
    return result


def usable(i, v):
    return i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)


def found(df, k=10):
    result = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0, k=k).orderBy("query_id", "rank").collect():
        result.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(result[r.query_id])
    return result


def recall(rows, got):
    wanted = brute(rows)
    hits = sum(len({i for i, _ in near} & {i for i, _ in got.get(q, [])}) for q, near in wanted.items())
    return hits / sum(map(len, wanted.values()))


def test_recall_over_several_shards_with_groups(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 700)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24)) * 5
    vectors = (centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert recall(rows, found(spark.createDataFrame(rows, SCHEMA))) >= 0.97


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200, 260)]  # one vector many times
    rows += [(300, None), (400, [0.0] * 4), (500, [float("nan")] + [1.0] * 3), (600, [1.0, None, 2.0, 3.0])]
    rows += [(None, [1.0] * 4), (700, [float("inf")] * 4), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (900, [-0.0, 5.0, 1.0, 2.0])]
    rows += [rows[5], rows[0]]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "rank": F.lit("y"), "hash": F.lit(1)})
    got, want = found(df), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=1e-12)
    assert [i for i, _ in got[200]] == list(range(201, 211))


def test_few_candidates_and_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(100, [1.0, 2.0])], SCHEMA)) == {}
    assert found(spark.createDataFrame([(100, [1.0, 2.0]), (3, [1.0, 5.0])], SCHEMA)) == {100: [(3, 3.0)]}

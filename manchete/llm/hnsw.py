"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node, which keeps its smallest ids. Nodes are dealt to shards of
about `SHARD_ROWS` by a hash of the vector. In a shard nodes enter in a seeded order:
each draws a level, and on every level up to it is linked to diverse near nodes among those
already there, which link back and are pruned to diverse ones when they have too many. As
a shard is bounded, the near nodes of an entering node are found exactly, in blocks of
distances, where the usual construction searches the unfinished graph. Levels are stored
as flat arrays of neighbour numbers, and the shards as a table in the shared folder.

Queries are packed in blocks and each block visits every shard: a beam descends the
levels and spreads on the lowest. The nearest of all shards are merged, by distance and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manchete.workspace import materialise

#: Nodes of a shard, about; queries of a block, about.
SHARD_ROWS = 4096
BLOCK_QUERIES = 256
#: Links that an entering node makes on a level; twice as many may stay on the lowest.
LINKS = 16
#: Near nodes among which diverse ones are chosen.
CANDIDATES = 64
#: Width of the beam on the lowest level, and on those above.
WIDE, NARROW = 160, 8
_ROWS_AT_ONCE = 256
SEED = 7

_INDEX = (
    "dim int, shard long, vectors binary, members array<array<long>>, tops array<int>, nodes binary, links binary"
)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T


def _diverse(vectors: np.ndarray, near: np.ndarray, far: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Of each row of candidates, by distance (-1: none), those nearer to the row's node than
    to any candidate chosen before; `most` at most, filled up with the nearest others if asked."""
    chosen = np.zeros(near.shape, bool)
    for at in range(0, len(near), 64):
        ids, dist = near[at : at + 64], far[at : at + 64]
        points = vectors[np.maximum(ids, 0)]
        norms = (points**2).sum(2)
        between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        take = chosen[at : at + 64]
        for j in range(ids.shape[1]):
            clear = ~(take[:, :j] & (between[:, j, :j] <= dist[:, j, None])).any(1)
            take[:, j] = (ids[:, j] >= 0) & clear & (take.sum(1) < most)
        if fill:
            for j in range(ids.shape[1]):
                take[:, j] |= (ids[:, j] >= 0) & (take.sum(1) < most)
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    kept = np.take_along_axis(near, order, 1)
    kept[~np.take_along_axis(chosen, order, 1)] = -1
    return np.pad(kept, ((0, 0), (0, most - kept.shape[1])), constant_values=-1).astype(np.int32)


def _level(vectors: np.ndarray, most: int) -> np.ndarray:
    """Flat links of one level, whose nodes are given in their order of entering."""
    n = len(vectors)
    width = min(CANDIDATES, max(n - 1, 1))
    near, far = np.full((n, width), -1), np.full((n, width), np.inf)
    for at in range(0, n, _ROWS_AT_ONCE):
        rows = vectors[at : at + _ROWS_AT_ONCE]
        dist = _squared(rows, vectors[: at + len(rows)])
        # A node sees only those that entered before it.
        dist[np.arange(dist.shape[1])[None, :] >= at + np.arange(len(rows))[:, None]] = np.inf
        w = min(width, dist.shape[1])
        ids = np.argpartition(dist, w - 1, axis=1)[:, :w]
        found = np.take_along_axis(dist, ids, 1)
        order = np.argsort(found, axis=1, kind="stable")
        ids, found = np.take_along_axis(ids, order, 1), np.take_along_axis(found, order, 1)
        near[at : at + len(rows), :w] = np.where(np.isinf(found), -1, ids)
        far[at : at + len(rows), :w] = found
    out = _diverse(vectors, near, far, min(LINKS, most), fill=False)
    source, target = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    source, target = source[target >= 0], target[target >= 0]
    source, target = np.concatenate((source, target)), np.concatenate((target, source))
    dist = ((vectors[source] - vectors[target]) ** 2).sum(1)
    order = np.lexsort((target, dist, source))
    source, target, dist = source[order], target[order], dist[order]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    inside = place < 2 * CANDIDATES
    source, target, dist, place = source[inside], target[inside], dist[inside], place[inside]
    width = max(int(place.max(initial=0)) + 1, most)
    near, far = np.full((n, width), -1), np.full((n, width), np.inf)
    near[source, place], far[source, place] = target, dist
    links = np.full((n, most), -1, np.int32)
    crowded = (near >= 0).sum(1) > most
    links[~crowded] = near[~crowded][:, :most]
    if crowded.any():
        links[crowded] = _diverse(vectors, near[crowded], far[crowded], most, fill=True)
    return links


def _build(table: pa.Table) -> pa.Table:
    """The graph of one shard: `tops` has the number of nodes of every level from the lowest up."""
    members = table.column("members").to_pylist()
    order = np.array(sorted(range(len(members)), key=lambda i: members[i][0]))
    rng = np.random.default_rng(SEED)
    order = order[rng.permutation(len(order))]
    members = [members[i] for i in order]
    vectors = np.array(table.column("vector").to_pylist(), np.float64)[order]
    levels = np.floor(-np.log(1 - rng.random(len(order))) / np.log(LINKS)).astype(int)
    tops, nodes, links = [], [], []
    for level in range(levels.max() + 1):
        own = np.flatnonzero(levels >= level)
        local = _level(vectors[own], 2 * LINKS if level == 0 else LINKS)
        tops.append(len(own))
        nodes.append(own.astype(np.int32))
        links.append(np.where(local >= 0, own[np.maximum(local, 0)], -1).astype(np.int32).ravel())
    return pa.table(
        {
            "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()),
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
            "vectors": [vectors.tobytes()],
            "members": pa.array([members], pa.list_(pa.list_(pa.int64()))),
            "tops": pa.array([tops], pa.list_(pa.int32())),
            "nodes": [np.concatenate(nodes).tobytes()],
            "links": [np.concatenate(links).tobytes()],
        }
    )


class Shard:
    """A shard's graph, ready to search."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.members = row["members"]
        nodes, links = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["links"], np.int32)
        self.levels = []
        for level, size in enumerate(row["tops"]):
            width = 2 * LINKS if level == 0 else LINKS
            place = np.full(len(self.vectors), -1, np.int32)
            place[nodes[:size]] = np.arange(size)
            self.levels.append((place, links[: size * width].reshape(size, width)))
            nodes, links = nodes[size:], links[size * width :]
        self.entry = int(np.flatnonzero(self.levels[-1][0] >= 0)[0])

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        gap = self.vectors[ids] - queries[:, None, :]
        return np.einsum("qmd,qmd->qm", gap, gap)

    def _beam(self, queries: np.ndarray, level: int, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found on a level, by distance: numbers (-1: none) and squared distances."""
        place, links = self.levels[level]
        every = np.arange(len(queries))
        seen = np.zeros((len(queries), len(self.vectors) + 1), bool)  # the last column stands for -1
        ids, done = starts, starts < 0
        dist = np.where(done, np.inf, self._distances(queries, np.maximum(starts, 0)))
        seen[every[:, None], ids] = True
        while True:
            waiting = np.where(done, np.inf, dist)
            best = waiting.argmin(1)
            active = np.flatnonzero(np.isfinite(waiting[every, best]))
            if not len(active):
                return ids, dist
            done[active, best[active]] = True
            near = links[place[ids[active, best[active]]]]
            fresh = ~seen[active[:, None], near] & (near >= 0)
            seen[active[:, None], near] = True
            near = np.where(fresh, near, -1)
            far = np.full(near.shape, np.inf)
            rows, columns = np.nonzero(fresh)
            gap = self.vectors[near[rows, columns]] - queries[active[rows]]
            far[rows, columns] = np.einsum("md,md->m", gap, gap)
            pad = ((0, 0), (0, near.shape[1]))
            ids, done = np.pad(ids, pad, constant_values=-1), np.pad(done, pad, constant_values=True)
            dist = np.pad(dist, pad, constant_values=np.inf)
            ids[active, -near.shape[1] :], dist[active, -near.shape[1] :] = near, far
            done[active, -near.shape[1] :] = ~fresh
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))

    def search(self, queries: np.ndarray, own: list[int], k: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, distance) of the `k` nearest ids of every query, its own left out."""
        found = np.full((len(queries), 1), self.entry)
        for level in range(len(self.levels) - 1, 0, -1):
            found, _ = self._beam(queries, level, found, NARROW)
        found, dist = self._beam(queries, 0, found, max(WIDE, 2 * k))
        for query, ids, squares in zip(own, found.tolist(), dist.tolist(), strict=True):
            nodes = sorted((d, self.members[i][0], i) for i, d in zip(ids, squares, strict=True) if i >= 0)[: k + 1]
            rows = sorted((d, m) for d, _, i in nodes for m in self.members[i] if m != query)[:k]
            for d, m in rows:
                yield query, m, float(np.sqrt(d))


def _usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, dim, vector, hash) of vectors that take part: known, finite and not zero."""
    values = F.col(vector).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).where(~bad & F.exists(values, lambda x: x != 0))
    # Adding zero turns a negative zero into zero.
    same = F.transform(values, lambda x: x + F.lit(0.0))
    return rows.select(F.col(id).cast("long").alias("id"), F.size(values).alias("dim"), same.alias("vector")).withColumn(
        "hash", F.xxhash64("vector")
    )


def build_index(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """One row per shard, written to the shared folder; every usable vector is in one.

    A node keeps the `k` + 1 smallest ids of its equal vectors, which is what a search for
    `k` can return of them.
    """
    order = Window.partitionBy("hash", "vector").orderBy("id")
    few = _usable(df, id, vector).withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k + 1)
    nodes = materialise(few.groupBy("hash", "dim", "vector").agg(F.array_sort(F.collect_set("id")).alias("members")))
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.select("dim", F.pmod("hash", F.lit(shards)).alias("shard"), "vector", "members")
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX))


def search(index: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` nearest vectors of each query in the index.

    Nearness is the Euclidean distance in double precision; ties go to smaller ids. Vectors
    of another length are no candidates, nor is the query's own id.
    """
    asked = _usable(queries, id, vector).dropDuplicates(["id", "hash"])
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    packed = asked.groupBy("dim", F.pmod("hash", F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("id", "vector")).alias("queries")
    )
    visits = packed.join(index.select("dim", "shard"), "dim").join(index, ["dim", "shard"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                points = np.array([q["vector"] for q in row["queries"]], np.float64)
                found = list(shard.search(points, [q["id"] for q in row["queries"]], k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array([q for q, _, _ in found], pa.int64()),
                        "vec_id": pa.array([m for _, m, _ in found], pa.int64()),
                        "score": pa.array([d for _, _, d in found], pa.float64()),
                    }
                )

    near = visits.mapInArrow(visit, "query_id long, vec_id long, score double")
    each = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest(
    df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10
) -> DataFrame:
    """The `k` nearest rows of `df` to each of its rows where `is_query` holds.

    Vectors that are null or zero or hold null or non-finite components take no part, nor do
    rows without id. Repeated rows count once; an id with several vectors is as near as the
    nearest of them. Fewer candidates than `k` are all returned; an empty table gives an
    empty result; other columns are not read.
    """
    return search(build_index(df, id, vector, k), df.where(is_query), id, vector, k)

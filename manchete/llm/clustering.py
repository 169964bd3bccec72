"""Centroid clustering in exact integers, with centroids filtered in PCA-rotated coordinates.

The principal axes come from the covariance of all vectors. Every vector is stored with its
coordinates on the leading axes and the norm of what is left beside them. For a vector x and
a centroid c the squared distance is at least |lead(x) - lead(c)|² + (rest(x) - rest(c))²:
the projected distance plus the squared difference of the residual norms. A round measures
the centroid with the smallest bound exactly, and then only those whose bound does not
exceed that distance. Distances are integers, and the bounds are lowered by far more than
their rounding error, so the axes decide the work but never the result.

The driver holds the centroids: `k` vectors, whatever the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import manchete.llm.common  # noqa: F401  (ships the package with the tasks)
from manchete.workspace import materialise

#: Sums travel in parts of so many bits, so that integers of any size add up exactly.
_LIMB = 30
#: Share of the squared norms by which a bound is lowered, for their rounding error (a residual norm near zero is right to 1e-7 of the whole only).
_MARGIN = 1e-5
#: Vectors looked at together.
_AT_ONCE = 2048
_LONGEST = (1 << 63) - 1

Centroids = list[list[int]]


def usable(vector: str, dims: int):
    """Condition: exactly `dims` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _narrow(dims: int) -> int:
    """Integers up to this size have squared distances that fit 62 bits."""
    return math.isqrt((1 << 62) // (4 * dims))


def _integer(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double, exactly."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


class _Split:
    """The integer vectors of a block: narrow ones as an array, wide ones as Python integers."""

    def __init__(self, values: np.ndarray, scale: int) -> None:
        self.wide = np.flatnonzero((np.abs(values) >= _narrow(values.shape[1]) // scale).any(axis=1)).tolist()
        values = values.copy()
        kept = values[self.wide]
        values[self.wide] = 0
        self.narrow = np.floor(values * scale).astype(np.int64)
        self.exact = {row: [_integer(x, scale) for x in v] for row, v in zip(self.wide, kept.tolist(), strict=True)}

    def row(self, row: int) -> list[int]:
        return self.exact.get(row) or self.narrow[row].tolist()


def _is_wide(centroid: list[int]) -> bool:
    return max(map(abs, centroid)) > _narrow(len(centroid))


def _squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


class _Axes:
    """The leading principal axes, as columns, around the mean."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray) -> None:
        self.mean, self.axes = mean, axes

    def rotate(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norm of every row."""
        moved = vectors - self.mean
        lead = moved @ self.axes
        rest = (moved * moved).sum(axis=1) - (lead * lead).sum(axis=1)
        return lead, np.sqrt(np.maximum(rest, 0))


class _Nearest:
    """Finds the nearest centroid of the vectors of a block, and its squared distance."""

    def __init__(self, centroids: Centroids, axes: _Axes, scale: int) -> None:
        self.all, self.scale = centroids, scale
        self.wide = [c for c, v in enumerate(centroids) if _is_wide(v)]
        narrow = [[0] * len(v) if c in self.wide else v for c, v in enumerate(centroids)]
        self.narrow = np.array(narrow, np.int64)
        self.lead, self.rest = axes.rotate(self.narrow.astype(float))
        self.measured = self.pairs = 0

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, vectors x centroids."""
        own, other = (lead * lead).sum(axis=1), (self.lead * self.lead).sum(axis=1)
        projected = own[:, None] + other[None, :] - 2 * (lead @ self.lead.T)
        bounds = np.maximum(projected, 0) + (rest[:, None] - self.rest[None, :]) ** 2
        size = (own + rest * rest)[:, None] + (other + self.rest * self.rest)[None, :]
        bounds -= _MARGIN * size + 1
        bounds[:, self.wide] = np.inf
        return bounds

    def find(self, vectors: _Split, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Number of the nearest centroid (ties: the smaller) and squared distance, for each row."""
        rows = np.arange(len(lead))
        nearest, distances = np.zeros(len(lead), np.int64), [0] * len(lead)
        if len(self.wide) < len(self.all):
            bounds = self.bounds(lead, rest)
            guess = bounds.argmin(axis=1)
            gap = vectors.narrow - self.narrow[guess]
            known = np.einsum("ij,ij->i", gap, gap)
            row, centroid = np.nonzero(bounds <= known[:, None])
            exact = np.full(bounds.shape, _LONGEST, np.int64)
            exact[rows, guess] = known
            gap = vectors.narrow[row] - self.narrow[centroid]
            exact[row, centroid] = np.einsum("ij,ij->i", gap, gap)
            self.measured += len(row)
            self.pairs += bounds.size
            nearest = exact.argmin(axis=1)
            distances = exact[rows, nearest].tolist()
        # Vectors and centroids too wide for 63 bits are measured without any filter.
        for at in rows.tolist() if self.wide else vectors.wide:
            others = range(len(self.all)) if at in vectors.exact or len(self.wide) == len(self.all) else self.wide
            found = [(_squared(vectors.row(at), self.all[c]), c) for c in others]
            if at not in vectors.exact and len(self.wide) < len(self.all):
                found.append((distances[at], int(nearest[at])))
            distances[at], nearest[at] = min(found)
        return nearest, distances


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(at, _AT_ONCE)


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(batch.num_rows, width)


def principal_axes(vectors: DataFrame, dims: int, share: float, scale: int) -> _Axes:
    """The leading axes of the covariance of all vectors: a pass that adds up dims x dims numbers.

    As many as hold `share` of the variance: few where vectors lie near a plane, nearly
    all where they go in all directions alike. Wide vectors are left out of the covariance, which results do not depend on.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((dims + 1, dims)), 0
        for batch in _blocks(batches):
            split = _Split(_matrix(batch, "vector", dims), scale)
            x = split.narrow.astype(float)
            total[0] += x.sum(axis=0)
            total[1:] += x.T @ x
            count += len(x)
        if count:
            places = np.arange(total.size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.append(total.ravel(), count))], names=["place", "value"])

    added = vectors.select("vector").mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = dict(added.collect())
    if not found:
        return _Axes(np.zeros(dims), np.eye(dims, 1))
    total = np.array([found[p] for p in range(dims * (dims + 1))]).reshape(dims + 1, dims)
    count = found[dims * (dims + 1)]
    mean = total[0] / count
    variances, axes = np.linalg.eigh(total[1:] / count - np.outer(mean, mean))
    held = np.cumsum(np.maximum(variances[::-1], 0))
    leading = min(int(np.searchsorted(held, share * held[-1])) + 1, dims)
    return _Axes(mean, axes[:, ::-1][:, :leading])


def _rotated(vectors: DataFrame, axes: _Axes, dims: int, scale: int) -> DataFrame:
    """`vectors` with leading coordinates and residual norm."""
    schema = T.StructType([*vectors.schema, *T.StructType.fromDDL("lead array<double>, rest double")])
    arrow = to_arrow_schema(schema)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            lead, rest = axes.rotate(_Split(_matrix(batch, "vector", dims), scale).narrow.astype(float))
            starts = np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32)
            leads = pa.ListArray.from_arrays(starts, lead.ravel())
            columns = [*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), leads.cast(arrow.field("lead").type), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return vectors.mapInArrow(rotate, schema)


def _sums(rotated: DataFrame, centroids: Centroids, axes: _Axes, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sum of every non-empty cluster."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(centroids, axes, scale)
        counts = np.zeros(len(centroids), np.int64)
        totals = [[0] * dims for _ in centroids]
        for batch in _blocks(batches):
            split = _Split(_matrix(batch, "vector", dims), scale)
            own, _ = nearest.find(split, _matrix(batch, "lead", axes.axes.shape[1]), batch.column("rest").to_numpy())
            added = np.zeros((len(centroids), dims), np.int64)
            np.add.at(added, own, split.narrow)  # a wide row counts here with zeros
            counts += np.bincount(own, minlength=len(centroids))
            for row, vector in split.exact.items():
                totals[own[row]] = [a + b for a, b in zip(totals[own[row]], vector, strict=True)]
            totals = [[a + b for a, b in zip(t, more, strict=True)] for t, more in zip(totals, added.tolist(), strict=True)]
        rows = []
        for c, n in enumerate(counts.tolist()):
            for place, value in enumerate([n, *totals[c]]) if n else ():
                limb, least = 0, 1 << _LIMB
                while not -least <= value < least:
                    rows.append((c, place, limb, value & (least - 1)))
                    value, limb = value >> _LIMB, limb + 1
                rows.append((c, place, limb, value))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["c", "place", "limb", "value"])

    parts = rotated.mapInArrow(add_up, "c long, place long, limb long, value long")
    found: dict[int, list[int]] = {}
    for c, place, limb, value in parts.groupBy("c", "place", "limb").agg(F.sum("value")).collect():
        found.setdefault(c, [0] * (dims + 1))[place] += value << (_LIMB * limb)
    return {c: (v[0], v[1:]) for c, v in found.items()}


def _assigned(rotated: DataFrame, id: str, centroids: Centroids, axes: _Axes, dims: int, scale: int) -> DataFrame:
    """`id`, `cluster` and `distance` of every vector; no distance where 63 bits cannot hold it."""
    schema = T.StructType([rotated.schema[id], *T.StructType.fromDDL("cluster int, distance long")])
    arrow = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(centroids, axes, scale)
        for batch in _blocks(batches):
            split = _Split(_matrix(batch, "vector", dims), scale)
            own, distances = nearest.find(split, _matrix(batch, "lead", axes.axes.shape[1]), batch.column("rest").to_numpy())
            shown = [d if d <= _LONGEST else None for d in distances]
            columns = [batch.column(id).cast(arrow.field(id).type), pa.array(own, pa.int32()), pa.array(shown, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rotated.mapInArrow(assign, schema)


def _long(x) -> int | None:
    return None if x is None or x > _LONGEST else int(x)


def first_centroids(vectors: DataFrame, id: str, k: int, salt: str, scale: int) -> Centroids:
    """The `k` vectors whose salted id has the smallest SHA-256, in that order.

    Vectors that share an id come by their components; those without an id come last.
    """
    order = F.sha2(F.concat(F.lit(salt), F.col(id).cast("string")), 256)
    chosen = vectors.select(order.alias("order"), "vector").orderBy(F.col("order").asc_nulls_last(), "vector").limit(k)
    return [[_integer(x, scale) for x in r["vector"]] for r in chosen.collect()]


def cluster_vectors(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40,
    rounds: int = 5, scale: int = 256, salt: str = "2:", share: float = 0.9,
) -> DataFrame:
    """Cluster of every usable vector: `id`, cluster, distance, cluster_inertia, inertia, centroid.

    A component x counts as the integer floor(scale * x). Vectors that are null, have other
    than `dims` components or hold a null or non-finite one take no part and give no row.
    Centroids start as the vectors whose salted ids hash smallest, fewer than `k` if there
    are fewer vectors; `rounds` times every vector goes to its nearest centroid (squared
    distance, ties to the smaller number) and each non-empty centroid moves to the exact
    floor of its mean. `centroid` is the final centroid as an array of decimal strings,
    which hold integers of any size. `share` is the part of the variance that the leading
    axes hold, which decides the work and no result. Repeated rows count as often as they come, and a null id
    is an id like others but is chosen last as a start. Components of any finite size are
    compared exactly; a distance or inertia beyond 63 bits is null. An empty table gives an
    empty result. Other columns are not read.
    """
    vectors = df.where(usable(vector, dims)).select(F.col(id).alias("__id"), F.col(vector).cast("array<double>").alias("vector"))
    centroids = first_centroids(vectors, "__id", k, salt, scale)
    axes = principal_axes(vectors, dims, share, scale)
    rotated = materialise(_rotated(vectors, axes, dims, scale))
    for _ in range(rounds):
        for c, (n, total) in _sums(rotated, centroids, axes, dims, scale).items() if centroids else ():
            centroids[c] = [x // n for x in total]
    if not centroids:  # then there is no vector either
        found = vectors.select("__id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = _assigned(rotated, "__id", centroids, axes, dims, scale)
    found = materialise(found)
    added = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = dict(found.groupBy("cluster").agg(added).collect())  # a row for each centroid at most
    inertia = None if None in sums.values() else sum(sums.values())
    rows = [
        (c, _long(sums[c]), _long(inertia), [str(x) for x in v]) for c, v in enumerate(centroids) if c in sums
    ]
    shown = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return found.join(F.broadcast(shown), "cluster").select(
        F.col("__id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def centroid_digest(centroid: str = "centroid"):
    """SHA-256 of the components of a centroid, joined by commas."""
    return F.sha2(F.concat_ws(",", centroid), 256)


"""Centroid clustering in exact integers, with annulus search.

Vectors are scaled and floored to integers. In each round the centroids are sorted by norm. A vector's distance to the centroid whose
norm is nearest its own is an upper bound; by the triangle inequality no centroid whose norm lies farther from the vector's own than that bound can be as near.
Binary search gives the run of norms inside this annulus, and only those centroids are compared, exactly; at equal distances the smaller number wins.
A round is one pass over the vectors; tasks add up their own vectors' components, and only these sums are shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrices

#: floats hold all squared distances exactly while no component is larger
EXACT = 1 << 22
LIMB = 32
LONG = range(-(2**63), 2**63)


def _floored(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: floats that hold integers, or Python's integers where one is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * scale)
    if np.abs(scaled).max(initial=0) <= EXACT:
        return scaled
    whole = lambda p, q: p * scale // q
    return np.array([[whole(*x.as_integer_ratio()) for x in row] for row in matrix.tolist()], object)


def _squares(v: np.ndarray) -> np.ndarray:
    return (v * v).sum(1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, of each vector; exact, ties to the smaller number.

    Both hold integers: as floats up to EXACT, else as Python's integers.
    """
    if object in (vectors.dtype, centroids.dtype):
        return _nearest_large(*([[int(x) for x in r] for r in m.tolist()] for m in (vectors, centroids)))
    lengths, own = (np.sqrt(_squares(m)) for m in (centroids, vectors))
    order = np.argsort(lengths, kind="stable")
    norms = lengths[order]
    # the centroid whose norm is nearest gives the upper bound
    right = np.searchsorted(norms, own).clip(1, len(norms) - 1) if len(norms) > 1 else np.zeros(len(own), int)
    left = np.maximum(right - 1, 0)
    first = np.where(np.abs(norms[left] - own) <= np.abs(norms[right] - own), left, right)
    bound = np.sqrt(_squares(vectors - centroids[order[first]]))
    slack = 1e-9 * (own + bound + norms[-1]) + 1e-9  # roundings may only widen the annulus
    low, high = np.searchsorted(norms, own - bound - slack, "left"), np.searchsorted(norms, own + bound + slack, "right")
    best, distance = np.full(len(own), -1), np.zeros(len(own))
    for rank, number in enumerate(order.tolist()):
        inside = np.flatnonzero((low <= rank) & (rank < high))
        if not len(inside):
            continue
        d = _squares(vectors[inside] - centroids[number])
        better = (best[inside] < 0) | (d < distance[inside]) | ((d == distance[inside]) & (number < best[inside]))
        best[inside[better]], distance[inside[better]] = number, d[better]
    return best, distance


def _nearest_large(vectors: list[list[int]], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` over Python's integers; norms are floors of roots, so the annulus is two wider on each side."""
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    order = sorted((isqrt(sum(x * x for x in c)), number) for number, c in enumerate(centroids))
    norms, found = [n for n, _ in order], []
    for v in vectors:
        own = isqrt(sum(x * x for x in v))
        near = bisect_left(norms, own)
        first = min((i for i in (near - 1, near) if 0 <= i < len(norms)), key=lambda i: abs(norms[i] - own))
        bound = isqrt(apart(v, centroids[order[first][1]])) + 1
        inside = order[bisect_left(norms, own - bound - 2) : bisect_right(norms, own + bound + 2)]
        found.append(min((apart(v, centroids[number]), number) for _, number in inside))
    return np.array([number for _, number in found]), np.array([d for d, _ in found], object)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Centroids as floats where these are exact, else as Python's integers."""
    if all(abs(x) <= EXACT for r in rows for x in r):
        return np.array(rows, np.float64)
    return np.array(rows, object)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value) with total = sum of value * 2 ** (LIMB * place); all but the last value below 2 ** LIMB."""
    place = 0
    while not -(1 << LIMB) < total < 1 << LIMB:
        yield place, total & ((1 << LIMB) - 1)
        total, place = total >> LIMB, place + 1
    yield place, total


SUMS = "cluster int, at int, place int, value long"


def _sums(centroids: list[list[int]], dims: int, scale: int) -> Callable:
    schema = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of components by cluster over all batches of a task; component -1 is the count."""
        totals, fixed = {}, _matrix(centroids)
        for batch in batches:
            for _, matrix in matrices(batch.column(0)):
                if matrix.shape[1] != dims:
                    continue
                v = _floored(matrix, scale)
                number, _ = nearest(v, fixed)
                for c in np.unique(number).tolist():
                    mine = v[number == c]
                    added = [len(mine), *map(int, mine.sum(0))]
                    totals[c] = [a + b for a, b in zip(totals[c], added, strict=True)] if c in totals else added
        rows = [(c, k - 1, place, value) for c, t in totals.items() for k, x in enumerate(t) for place, value in _limbs(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _assigned(centroids: list[list[int]], dims: int, scale: int) -> Callable:
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = _matrix(centroids)
        for batch in batches:
            for places, matrix in matrices(batch.column(0)):
                if matrix.shape[1] == dims:
                    number, d = nearest(_floored(matrix, scale), fixed)
                    d = pa.array([int(x) if int(x) in LONG else None for x in d.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(places)), pa.array(number, pa.int32()), d], schema=schema)

    return run


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``dims`` components, none null or non-finite; component x becomes floor(scale * x). The first centroids are the ``k`` kept
    vectors with the smallest sha256 of seed and id, in that order (rows with a null id come last, repeated ids by their components); with fewer vectors there are fewer. Each
    round assigns every vector to the nearest centroid (ties: smaller number) and replaces each centroid that has vectors by the floor of their mean. Repeated rows
    are vectors of their own. Integers are exact at any size; a distance or inertia that no long holds is null. No kept vector: no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    vectors = df.select(df[embedding].cast("array<double>").alias("embedding"), df[vec_id].cast("long").alias("id"))
    whole = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    drawn = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    start = vectors.filter(whole).select(drawn.alias("drawn"), "id", "embedding").orderBy(F.asc_nulls_last("drawn"), "embedding").limit(k).collect()  # k rows
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [list(map(int, _floored(np.array([r.embedding], np.float64), scale)[0])) for r in start]
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(_sums(centroids, dims, scale), SUMS).groupBy("cluster", "at", "place").agg(F.sum("value").alias("value")).collect()  # k * (dims + 1) sums
        total = {}
        for r in sums:
            total[r.cluster, r["at"]] = total.get((r.cluster, r["at"]), 0) + (r.value << (LIMB * r.place))
        centroids = [[total.get((c, i), 0) // total[c, -1] for i in range(dims)] if (c, -1) in total else old for c, old in enumerate(centroids)]
    out = materialize(vectors.select("embedding", "id").mapInArrow(_assigned(centroids, dims, scale), "id long, cluster int, distance long"))
    whole_sum = lambda: F.when(F.count("distance") == F.count("*"), F.expr("try_cast(sum(cast(distance as decimal(38,0))) as bigint)"))
    by = out.groupBy("cluster").agg(whole_sum().alias("cluster_inertia"))
    total = out.agg(whole_sum().alias("inertia")).first().inertia
    digest = F.create_map(*[F.lit(x) for c, row in enumerate(centroids) for x in (c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())])
    return out.join(F.broadcast(by), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))

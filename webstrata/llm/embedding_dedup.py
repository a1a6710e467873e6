"""Near duplicates among embeddings by an inverted multi-index.

Vectors of length one are cut in halves. Each half has a codebook of its own, and the pairs of codes are the cells of a product grid; a vector is
filed in the cell of its nearest codes. Only vectors with equal labels and lengths are compared. A pair is looked for from the lower of its two cells: a vector visits
cells in the order of their cost, the sum over both halves of the squared distance to the border of the code's own region, by a walk over the two
sorted lists of codes. It stops at the cost within which the ``recall`` asked for of simulated partners at exactly the threshold is found; nearer partners lie nearer. Found pairs are verified by their
cosine in double precision.

In a crowded cell a ball is laid around its densest place, with half of the angle of the threshold as radius: any two vectors in it are linked, whoever
files or visits them. These links are counted by the ball's size and never compared, so a group of near copies costs time in proportion to its members. All other pairs of
a cell meet in blocks of bounded size; a block returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import acos, cos

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .near_dedup import connected_components, whole_groups
from .vectors import matrices, unit

THRESHOLD, RECALL = 0.93, 0.995
#: vectors of the sample that codebooks and the stopping cost are fitted on; rounds of its clustering; vectors of a label that a cell is meant to hold
SAMPLE, SAMPLE_BYTES, FIT_ROUNDS, PER_CELL, MOST_CODES = 20_000, 64_000_000, 8, 64, 1024
#: members of a block; members of a crowded cell that place its ball
BLOCK, BALL_SAMPLE = 1024, 256
#: balls that are broadcast at once; more are shuffled
FEW_BALLS = 4096


def _apart(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` codes of the rows of ``x``: means of nearest rows, from rows spread over the sample."""
    codes = np.unique(x, axis=0)
    codes = codes[np.random.default_rng(0).permutation(len(codes))[:k]]
    for _ in range(FIT_ROUNDS):
        own = _apart(x, codes).argmin(1)
        n = np.bincount(own, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


@dataclass(frozen=True)
class Grid:
    """Codebooks of both halves of vectors of one length, and the cost at which a search stops."""

    half: int
    codes: tuple[np.ndarray, np.ndarray]
    stop: float = 0.0

    def costs(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The own codes of each half and the squared distance to the border of every code's region."""
        own, out = [], []
        for part, codes in zip((x[:, : self.half], x[:, self.half :]), self.codes, strict=True):
            d = _apart(part, codes)
            nearest = d.argmin(1)
            between = np.sqrt(_apart(codes, codes))[nearest]
            border = (d - d[np.arange(len(x)), nearest][:, None]) / np.where(between > 0, 2 * between, np.inf)
            border[np.arange(len(x)), nearest] = 0
            own.append(nearest)
            out.append(np.maximum(border, 0) ** 2)
        return own, out

    def cell(self, own: list[np.ndarray]) -> np.ndarray:
        return own[0] * len(self.codes[1]) + own[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own cell of each vector, and the cells from it on that a search of it opens, its own among them.

        Both lists of codes are sorted by cost. With the r-th code of the first list go the codes of the second whose cost still fits: a run from its start,
        which only gets shorter as r grows.
        """
        own, (a, b) = self.costs(x)
        cell, second = self.cell(own), len(self.codes[1])
        order_a, order_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        who, opened = [], []
        for r in range(a.shape[1]):
            left = self.stop - a[:, r]
            if not (left >= 0).any():
                break
            row, place = np.nonzero(b <= left[:, None])
            who.append(row)
            opened.append(order_a[row, r] * second + order_b[row, place])
        who, opened = np.concatenate(who), np.concatenate(opened)
        later = opened >= cell[who]
        who, opened = who[later], opened[later]
        order = np.lexsort((opened, who))
        return cell, np.split(opened[order], np.cumsum(np.bincount(who, minlength=len(x)))[:-1])


def fit_grid(sample: np.ndarray, k: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Grid:
    """A grid of ``k`` codes a half. ``sample``: vectors of length one.

    Partners at the threshold differ from a vector in all components or in those of one half only, in equal parts.
    """
    half = sample.shape[1] // 2
    grid = Grid(half, (_fit(sample[:, :half], k), _fit(sample[:, half:], k)))
    random = np.random.default_rng(1)
    x = sample[random.permutation(len(sample))[:2000]]
    _, (a, b) = grid.costs(x)
    found, at = [], np.arange(len(x))
    for where in [slice(None), slice(half), slice(half, None)] * 4:
        if not x[:, where].shape[1]:
            continue
        u = np.zeros_like(x)
        u[:, where] = random.normal(size=u[:, where].shape)
        u = unit(u - (u * x).sum(1)[:, None] * x)
        (i, j), _ = grid.costs(unit(threshold * x + np.sqrt(1 - threshold**2) * u))
        found.append(a[at, i] + b[at, j])
    return Grid(half, grid.codes, float(np.quantile(np.concatenate(found), recall)))


def fit_grids(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> dict[int, Grid]:
    """Grids by vector length, fitted on the SAMPLE vectors with the smallest hashes; lengths that aren't among them have one cell.

    The sample has at most SAMPLE_BYTES. The number of codes grows with the square root of the number of vectors that share a vector's label, on average.
    """
    each, n = vectors.groupBy("label", "dims").count(), F.col("count").cast("double")
    size = each.agg((F.sum(n * n) / F.sum(n)).alias("n"), F.max("dims").alias("dims")).first()
    k = max(1, min(MOST_CODES, round((size.n / PER_CELL) ** 0.5)))
    sample = vectors.orderBy(F.xxhash64("vector", "row")).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size.dims)))).select("dims", "vector").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(r.dims, []).append(np.frombuffer(r.vector, np.float64))
    return {dims: fit_grid(np.stack(v), k, threshold, recall) for dims, v in by.items()}


VECTORS = "row long, label string, dims int, vector binary"


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one of all rows that can be linked."""
    for batch in batches:
        for places, matrix in matrices(batch.column(2)):
            vectors = unit(matrix)
            some = np.flatnonzero(np.abs(vectors).max(1) > 0)
            places, vectors = pa.array(places[some]), vectors[some]
            if len(places):
                columns = [batch.column(0).take(places), batch.column(1).take(places), pa.array(np.full(len(places), vectors.shape[1], np.int32)), pa.array([v.tobytes() for v in vectors], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "label", "dims", "vector"])


def _filed(grids: dict[int, Grid]) -> Callable:
    schema = pa.schema([("row", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("vector", pa.binary()), ("home", pa.int64()), ("visits", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                places = np.flatnonzero(dims == d)
                for part in np.array_split(places, -(-len(places) // 2048)):
                    mine = batch.take(pa.array(part))
                    if d in grids:
                        x = np.frombuffer(b"".join(mine.column(3).to_pylist()), np.float64).reshape(len(part), d)
                        home, visits = grids[d].visits(x)
                    else:
                        home, visits = np.zeros(len(part), np.int64), [np.zeros(1, np.int64)] * len(part)
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], schema=schema)

    return run


CELL = ["label", "dims", "cell"]


def _place_ball(threshold: float) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The centre of the densest ball of a few vectors of a cell: the mean of those in the ball around the one with most others in its own."""
        x = np.stack([np.frombuffer(v, np.float64) for v in group["vector"]])
        inside = x @ x.T >= cos(acos(threshold) / 2)
        centre = unit(x[inside[inside.sum(1).argmax()]].mean(0)[None])[0]
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in CELL}, "centre": [centre.tobytes()]})

    return run


def _in_ball(threshold: float) -> Callable:
    """Adds main: the vector lies in the ball of the cell it is filed in or visits."""
    least = cos(acos(threshold) / 2) + 1e-9

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            pairs = zip(batch.column("vector").to_pylist(), batch.column("centre").to_pylist(), strict=True)
            main = [(np.frombuffer(v, np.float64) * np.frombuffer(c, np.float64)).sum() >= least for v, c in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(main, pa.bool_())], [*batch.schema.names[:n], "main"])

    return run


FOUND = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])
BY_BLOCK = [*CELL, "filed_part", "visit_part"]


def _verify(threshold: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, n, to): links of each row inside a block, and the smallest row it reaches there."""
        for table, first in whole_groups(batches, BY_BLOCK):
            bounds = first if first[-1] == table.num_rows else np.append(first, table.num_rows)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                g = table.slice(lo, hi - lo)
                filed = g.column("filed").to_numpy(zero_copy_only=False).astype(bool)
                if filed.all() or not filed.any():
                    continue
                rows, home, main = g.column("row").to_numpy(), g.column("at_home").to_numpy(zero_copy_only=False).astype(bool), g.column("main").to_numpy(zero_copy_only=False).astype(bool)
                x = np.frombuffer(b"".join(g.column("vector").to_pylist()), np.float64).reshape(len(rows), -1)
                e, v = np.flatnonzero(filed), np.flatnonzero(~filed)
                hit = x[v] @ x[e].T >= threshold
                hit &= ~(home[v][:, None] & (rows[v][:, None] >= rows[e])) & ~(main[v][:, None] & main[e])
                if not hit.any():
                    continue
                # the smallest row reached: rows of both sides take the least of their partners' until nothing changes
                to_e, to_v = rows[e].copy(), rows[v].copy()
                twin = dict(zip(rows[e].tolist(), range(len(e)), strict=True))
                same = np.array([(i, twin[r]) for i, r in enumerate(rows[v].tolist()) if r in twin], np.int64).reshape(-1, 2)
                top = np.iinfo(np.int64).max
                while True:
                    before = to_v.sum(), to_e.sum()
                    to_v = np.minimum(to_v, np.where(hit, to_e, top).min(1))
                    to_e = np.minimum(to_e, np.where(hit, to_v[:, None], top).min(0))
                    both = np.minimum(to_v[same[:, 0]], to_e[same[:, 1]])
                    to_v[same[:, 0]], to_e[same[:, 1]] = both, both
                    if before == (to_v.sum(), to_e.sum()):
                        break
                n_v, n_e = hit.sum(1), hit.sum(0)
                some_v, some_e = np.flatnonzero(n_v), np.flatnonzero(n_e)
                columns = [np.concatenate([rows[v][some_v], rows[e][some_e]]), np.concatenate([n_v[some_v], n_e[some_e]]), np.concatenate([to_v[some_v], to_e[some_e]])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    return run


def _links(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(row, n, to): parts of the number of links of each row, and rows it reaches; in all, edges of the same components."""
    filed = materialize(vectors.mapInArrow(_filed(fit_grids(vectors, threshold, recall)), f"{VECTORS}, home long, visits array<long>"))
    size = materialize(
        filed.select("label", "dims", F.explode("visits").alias("cell"), "home").groupBy(*CELL).agg(F.count("*").alias("visitors"), F.count(F.when(F.col("cell") == F.col("home"), 1)).alias("members"))
    )
    crowded = size.filter(F.col("members") > BLOCK).select(*CELL)
    some = W.partitionBy(*CELL).orderBy(F.xxhash64("row"), "row")
    at_home = filed.select("row", "label", "dims", F.col("home").alias("cell"), "vector").join(crowded, CELL, "left_semi")
    few = at_home.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= BALL_SAMPLE).drop("place", "row")  # the limit goes before the shuffle
    balls = materialize(few.groupBy(*CELL).applyInPandas(_place_ball(threshold), "label string, dims int, cell long, centre binary"))
    n_balls = balls.count()

    def with_main(rows: DataFrame) -> DataFrame:
        if not n_balls:
            return rows.withColumn("main", F.lit(False))
        joined = rows.join(F.broadcast(balls) if n_balls <= FEW_BALLS else balls, CELL, "left")
        inside = joined.filter("centre is not null").mapInArrow(_in_ball(threshold), "label string, dims int, cell long, row long, vector binary, filed boolean, at_home boolean, main boolean")
        return inside.unionByName(joined.filter("centre is null").drop("centre").withColumn("main", F.lit(False)))

    # a cell that holds no member has nothing to find, nor has one with a single member that nobody else visits
    useful = size.filter("members > 0 and visitors > 1").select(*CELL)
    visiting = filed.select("label", "dims", F.explode("visits").alias("cell"), "row", "vector", F.lit(False).alias("filed"), "home").withColumn("at_home", F.col("cell") == F.col("home")).drop("home")
    visiting = visiting.join(useful, CELL, "left_semi").select(*CELL, "row", "vector", "filed", "at_home")
    members = filed.select("label", "dims", F.col("home").alias("cell"), "row", "vector", F.lit(True).alias("filed"), F.lit(True).alias("at_home"))
    both = with_main(visiting.unionByName(members))
    shape = both.groupBy(*CELL).agg(
        *[F.count(F.when(side & (F.col("main") == m), 1)).alias(f"{name}_{kind}") for name, side in (("filed", F.col("filed")), ("visit", ~F.col("filed"))) for kind, m in (("main", True), ("rest", False))],
        F.min(F.when(F.col("filed") & F.col("main"), F.col("row"))).alias("leader"),
    )
    shape = materialize(shape)
    # blocks: members of the ball meet those outside it, those outside meet all
    dealt = both.join(shape.drop("leader"), CELL)
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("row"), F.greatest(n, F.lit(1))).cast("int")
    side = lambda a, b: F.when(F.col("filed"), a).otherwise(b)
    own_rest, own_main = side(blocks("filed_rest"), blocks("visit_rest")), side(blocks("filed_main"), blocks("visit_main"))
    other_rest, other_main = side(blocks("visit_rest"), blocks("filed_rest")), side(blocks("visit_main"), blocks("filed_main"))
    part = F.when(F.col("main"), own_rest + spread(own_main)).otherwise(spread(own_rest))
    last = F.when(F.col("main"), other_rest).otherwise(other_rest + other_main) - 1
    dealt = dealt.select(*CELL, "row", "vector", "filed", "at_home", "main", part.alias("part"), last.alias("last")).filter("last >= 0")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    own, other = F.col("part"), F.col("other")
    dealt = dealt.select(*CELL, side(own, other).alias("filed_part"), side(other, own).alias("visit_part"), "row", "vector", "filed", "at_home", "main")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *BY_BLOCK).sortWithinPartitions(*BY_BLOCK)
    found = dealt.mapInArrow(_verify(threshold), "row long, n long, to long")
    if n_balls:  # all pairs of a ball: a member meets the other members and the visitors from elsewhere, a visitor the members
        sizes = shape.filter("filed_main > 0").select(*CELL, "leader", "filed_main", "visit_main")
        inside = both.filter("main and not filed").select(*CELL, "row", "at_home")
        linked = inside.join(F.broadcast(sizes) if n_balls <= FEW_BALLS else sizes, CELL)
        linked = linked.select("row", F.when(F.col("at_home"), F.col("visit_main") - 1).otherwise(F.col("filed_main")).alias("n"), F.col("leader").alias("to"))
        found = found.unionByName(linked.filter("n > 0"))
    return materialize(found)


def near_duplicate_vectors(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Linked: cosine >= ``threshold`` (above 0) in double precision, with labels that are equal and not null and vectors of the same length. Null, empty and zero vectors and those with a null
    or non-finite component are linked with nothing. n_links counts other rows, so rows that repeat an id or a vector count one another; component_id is the smallest id
    that can be reached, null ids aside; kept: it is the row's own id, or neither is there. No link below the threshold is returned; of those at it ``recall`` are found, of closer ones more. Other columns aren't read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    rows = materialize(df.select(F.monotonically_increasing_id().alias("row"), df[vec_id].cast("long").alias("vec_id"), df[label].cast("string").alias("label"), df[embedding].cast("array<double>").alias("embedding")))
    vectors = materialize(rows.filter("label is not null and size(embedding) > 0").select("row", "label", "embedding").mapInArrow(_units, VECTORS))
    found = _links(vectors, threshold, recall) if vectors.limit(1).count() else df.sparkSession.createDataFrame([], "row long, n long, to long")
    counts = materialize(found.groupBy("row").agg(F.sum("n").alias("n_links")))
    component = connected_components(found.select(F.col("row").alias("a"), F.col("to").alias("b")))
    out = rows.select("row", "vec_id").join(counts, "row", "left").join(component.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    out = materialize(out.drop("row"))
    least = materialize(out.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    out = out.join(least, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

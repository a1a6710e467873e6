import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webstrata.llm import centroids, embedding_dedup, merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
EMBEDDINGS = "vec_id long, embedding array<double>, label int, cluster string, component int, n long"


# centroid clustering


def floored(x, scale=1024):
    p, q = float(x).as_integer_ratio()
    return p * scale // q


def plain_clustering(rows, k, rounds, dims):
    """The contract in Python's integers: (id, cluster, distance) and the centroids."""
    kept = [(i, [floored(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [find(v)[1] for _, v in kept]
        new = list(centres)
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                new[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        centres = new
    return [(i, *find(v)[::-1]) for i, v in kept], centres


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=12), st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=9), st.sampled_from([1, 10**6, 10**200]))
def test_annulus_search_finds_the_nearest_and_smallest(vectors, codes, size):
    scaled = lambda m: [[x * size for x in r] for r in m]
    make = lambda m: np.array(scaled(m), np.float64 if size < 10**7 and size * 6 <= centroids.EXACT else object)
    number, distance = centroids.nearest(make(vectors), make(codes))
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(scaled(codes))) for v in scaled(vectors)]
    assert [(int(d), int(j)) for d, j in zip(distance.tolist(), number.tolist(), strict=True)] == want


def test_annulus_leaves_centroids_out():
    """Norms far apart: only centroids inside the annulus are compared."""
    compared = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, int):
                compared.append(key)
            return super().__getitem__(key)

    codes = np.array([[10.0 * 3**i, 0.0] for i in range(9)]).view(Counting)
    number, _ = centroids.nearest(np.array([[11.0, 1.0], [90.0, 2.0]]), codes)
    assert number.tolist() == [0, 2] and len(compared) < 6


@pytest.mark.parametrize("large", [1.0, 1e7, 1e150])
def test_clustering_equals_plain_rounds(spark, large):
    rng = random.Random(4)
    centres = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(5)]
    rows = [(i, [large * (c + rng.gauss(0, 0.3)) for c in centres[i % 5]]) for i in range(160)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0, 3.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (206, [-0.0005] * 4)]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], EMBEDDINGS).repartition(3)
    out = centroids.cluster(df, k=5, rounds=4, dims=4).collect()
    want, codes = plain_clustering(rows, 5, 4, 4)
    long = lambda x: x if x < 2**63 else None
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in out], key=str) == sorted([(i, j, long(d)) for i, j, d in want], key=str)
    total = [sum(d for _, j, d in want if j == c) for c in range(5)]
    for r in out:
        assert r.cluster_inertia == long(total[r.cluster]) or any(long(d) is None for _, j, d in want if j == r.cluster)
        assert r.inertia == long(sum(total)) or any(long(d) is None for _, _, d in want)
        assert r.centroid_sha256 == H(",".join(map(str, codes[r.cluster])))


def test_clustering_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0], 1, "", 1, 1), (2, [1.0, 1.0], 1, "", 1, 1), (3, [None, 1.0], 1, "", 1, 1)], EMBEDDINGS)
    out = centroids.cluster(df, dims=2).collect()
    assert sorted(r.vec_id for r in out) == [1, 2] and all(r.distance == r.inertia == 0 for r in out)
    assert len({r.cluster for r in out}) == 1 and out[0].cluster == 0  # two equal centroids: the smaller number
    assert centroids.cluster(df.filter("vec_id = 3"), dims=2).collect() == []
    assert centroids.cluster(df, dims=3).count() == 0


def test_sums_of_any_size_are_cut_into_limbs():
    for total in (0, 1, -1, 2**32, -(2**32), 2**63, -(2**200) + 5, 3**300):
        parts = list(centroids._limbs(total))
        assert sum(v << (32 * p) for p, v in parts) == total and all(abs(v) <= 2**32 for _, v in parts)


# manifest


def leaf(row, low=False):
    row = list(row)
    if low and row[4] is not None:
        row[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """The root and a function that gives the siblings of each level for a place."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])

    def path(i):
        out = []
        for level in levels[:-1]:
            at = i // 8 * 8
            out.append((level[at:i], level[i + 1 : at + 8]))
            i //= 8
        return out

    return levels[-1][0], path


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {g: sorted([r for r in rows if r[2] == g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: plain_tree([leaf(r) for r in by[g]]) for g in langs}
    root, above = plain_tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            path = trees[g][1](i) + above(k)
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                h = H(*left, h, *right)
            out.append((r[0], leaf(r), trees[g][0], root, H(*[x for left, right in path for x in left + right]), h, h == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars int, text string, root string, idx int, n int, digest string"


@pytest.mark.parametrize("sizes", [[1], [8], [9], [65, 1, 8, 2], [3] * 9, [530, 64, 7]])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rng = random.Random(sum(sizes))
    langs = [None, "", "e", "É", "日本", "zz", "a:b", "=", "~"]
    rows = [(rng.choice([None, *range(-5, 10_000)]) if rng.random() < 0.1 else 7 * i + 1000 * k, rng.choice([None, "web", "a:1"]), langs[k], rng.choice([None, i]), rng.choice([None, "", "Ab É X", f"T{i}", "same", "Xy " * 20_000 if i == 3 else "lower"])) for k, n in enumerate(sizes) for i in range(n)]
    rows += [rows[0], rows[-1], rows[-1]]  # repeated rows are leaves of their own
    df = spark.createDataFrame([(*r, "r", 1, 2, "d") for r in rows], DOCS).repartition(3)
    docs = merkle.document_manifest(df)
    got = sorted([tuple(r) for r in merkle.proofs(docs).collect()], key=str)
    assert got == sorted(plain_manifest(rows), key=str)
    assert docs.columns == ["doc_id", "tampered", "leaf", "subroot", "root", "path"]


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.proofs(merkle.document_manifest(df)).collect() == []


# near-duplicate embeddings


def unit(v):
    return v / np.linalg.norm(v)


def plain_links(rows, threshold):
    """n_links, component_id and kept by comparing all pairs."""
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    vectors = [unit(np.array(v) / np.abs(v).max()) if good(v) else None for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and float(a @ b) >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, n[i], least, vec_id == least))
    return out


def planted(rng, groups, singles, dims=16, near=0.1, label=1):
    """Rows of groups of near copies around random places, and of vectors alone."""
    rows = []
    for size in groups:
        at = unit(rng.normal(size=dims))
        rows += [unit(at + near * unit(rng.normal(size=dims))) * rng.uniform(0.1, 9) for _ in range(size)]
    rows += [unit(rng.normal(size=dims)) for _ in range(singles)]
    return [(v.tolist(), label) for v in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 5, 6) for i, v, label in rows], EMBEDDINGS).repartition(3)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize(("block", "per_cell"), [(1024, 64), (1024, 4), (16, 4), (16, 100_000)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, per_cell):
    """One cell and many; groups that fit into a block and balls of crowded cells that straddle borders."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    rng = np.random.default_rng(block + per_cell)
    some = planted(rng, [120, 40, 6, 2, 2], 150) + planted(rng, [90], 20, label=2) + planted(rng, [5], 5, label=None) + planted(rng, [4], 3, dims=7, label=2) + planted(rng, [3], 2, dims=1, label=1)
    some += [some[0], some[0], some[125], (None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([float("inf")] * 16, 1), ([x * 1e300 for x in some[0][0]], 1), ([x * 1e-310 for x in some[0][0]], 1)]
    rows = [(i * 3 % 1009, v, label) for i, (v, label) in enumerate(some)]
    rows += [(rows[2][0], rows[2][1], 1), (None, rows[5][1], 1), (None, unit(rng.normal(size=16)).tolist(), 1), (5000, rows[1][1], 2)]
    assert result(embedding_dedup.near_duplicate_vectors(frame(spark, rows), recall=1.0)) == sorted(plain_links(rows, 0.93), key=str)


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs at exactly the threshold, whose difference lies in all components, in one half or in a few."""
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 8)
    rng, rows, dims = np.random.default_rng(8), [], 64
    for i in range(500):
        x = unit(rng.normal(size=dims))
        u = np.zeros(dims)
        where = [slice(None), slice(32), slice(32, None), slice(5)][i % 4]
        u[where] = rng.normal(size=u[where].shape)
        u = unit(u - (u @ x) * x)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, (0.9301 * x + math.sqrt(1 - 0.9301**2) * u).tolist(), 1)]
    want = {r[0] for r in plain_links(rows, 0.93) if r[1]}
    got = {r.vec_id for r in embedding_dedup.near_duplicate_vectors(frame(spark, rows)).collect() if r.n_links}
    assert got <= want and len(want) == 1000 and len(got) >= 0.98 * len(want)


def test_search_visits_few_cells_in_order_of_cost():
    rng = np.random.default_rng(3)
    x = np.stack([unit(v) for v in rng.normal(size=(4000, 64))])
    grid = embedding_dedup.fit_grid(x, 16)
    home, visits = grid.visits(x[:300])
    own, (a, b) = grid.costs(x[:300])
    for i in range(300):
        cost = (a[i][:, None] + b[i]).ravel()
        assert sorted(visits[i].tolist()) == [c for c in np.flatnonzero(cost <= grid.stop) if c >= home[i]] and home[i] in visits[i]
    assert sum(map(len, visits)) / 300 < 0.2 * 256


def test_near_vectors_edges(spark):
    none = frame(spark, [(1, [1.0], 1)]).filter("false")
    assert result(embedding_dedup.near_duplicate_vectors(none)) == []
    useless = frame(spark, [(1, None, 1), (2, [1.0], None), (None, [0.0], 1)])
    assert result(embedding_dedup.near_duplicate_vectors(useless)) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicate_vectors(none, threshold=0)

"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document is its set of word shingles. Its signature has SYMBOLS min-hash values; the first INDEXED of them are the index:
two signatures within RADIUS differing symbols must, by pigeonhole, have a chunk of CHUNK symbols with at most
RADIUS // chunks errors. The allowed errors of each chunk are enumerated by leaving symbols out, so every such pair shares a key of
CHUNK - ERRORS symbols. While a key with more members than fit into a block holds several components and at least half of the comparisons link, each document is first compared with
one other member of its keys, on full sets; that joins a large group at a cost in proportion to its size. Then the pairs of different components that share
a key are compared by whole signatures, and what may be linked is confirmed on full sets, inside blocks of bounded size. Links that only repeat
a known component aren't looked for; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, marked, materialize, only_cache, whole_text

SYMBOLS, INDEXED, CHUNK, RADIUS = 64, 28, 4, 13
ERRORS = RADIUS // (INDEXED // CHUNK)
KEEP = [(c, left) for c in range(INDEXED // CHUNK) for left in combinations(range(c * CHUNK, (c + 1) * CHUNK), CHUNK - ERRORS)]
#: whole signatures: of 64 symbols that agree with probability 0.8, 36 or more do but for 1 in 100,000 pairs
AGREE = 36
BLOCK, CONFIRM_BLOCK = 1024, 256
#: most rounds of comparing with a leader; shared keys that make a leader worth it; the keys that have one: the first of each chunk
LEADER_ROUNDS, LEADER_SHARED, LEADER_KEYS = 6, 2, range(0, len(KEEP), len(KEEP) * CHUNK // INDEXED)
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
XOR, MULTIPLY = _RANDOM.integers(0, 2**64, SYMBOLS, np.uint64), _RANDOM.integers(0, 2**64, SYMBOLS, np.uint64) | np.uint64(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingles:
    """Sets of 64-bit shingle hashes; word hashes are kept for each worker."""

    def __init__(self, keep: int = 300_000):
        self.known, self.keep = {}, keep

    def of(self, text: str, size: int) -> np.ndarray:
        """Sorted distinct hashes of runs of ``size`` words (A-Z lower-cased); of fewer words, the whole run as one."""
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and the six ASCII spaces
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        only_cache(known)
        if len(known) > self.keep:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for w in {w for w, h in zip(words, found, strict=True) if h is None}:
                known[w] = xxhash.xxh64_intdigest(w)
            found = map(known.__getitem__, words)
        hashes = np.fromiter(found, np.uint64, len(words))
        n = max(1, len(words) - size + 1)
        out = np.full(n, len(words) if len(words) < size else size, np.uint64)
        for k in range(min(size, len(words))):
            out = (out ^ hashes[k : k + n]) * M1
            out ^= out >> np.uint64(31)
        return np.unique(out * M2)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of SYMBOLS different hashes over the set."""
    if len(shingles) > 512:  # parts that stay in the processor's cache
        return np.minimum.reduce([signature(shingles[i : i + 512]) for i in range(0, len(shingles), 512)])
    return ((shingles[None, :] ^ XOR[:, None]) * MULTIPLY[:, None]).min(1)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each chunk and each way to leave out its allowed errors."""
    out = np.empty(len(KEEP), np.uint64)
    for i, (_, left) in enumerate(KEEP):
        h = np.uint64(i + 1)
        for k in left:
            h = (h ^ sig[k]) * M1
            h ^= h >> np.uint64(29)
        out[i] = h
    return out.view(np.int64)


_SHINGLES = Shingles()
SKETCH = "doc_id long, n_shingles long, set1 long, set2 long, sketch binary, keys array<long>, packed binary"


def _sketches(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s = _SHINGLES.of(text, size)
                    if not len(s):
                        rows.append((doc_id, 0, None, None, None, None, None))
                        continue
                    sig, digest = signature(s), np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
                    keys = index_keys(sig)
                    rows.append((doc_id, len(s), int(digest[0]), int(digest[1]), sig.astype(np.uint8).tobytes(), keys, keys.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                with np.errstate(over="ignore"):
                    sets = [_SHINGLES.of(text, size).tobytes() for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)

    return run


def whole_groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows sorted by group, cut only between groups, with the first row of each group (and the end)."""

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for c in by:
            v = table.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        first = starts(table)
        if len(first) > 1:  # the last group may go on in the next batch
            yield table.slice(0, first[-1]).combine_chunks(), first
            table = table.slice(first[-1])
        kept = table
    if kept is not None and kept.num_rows:
        first = starts(kept)
        yield kept.combine_chunks(), np.concatenate([first, [kept.num_rows]])


BLOCK_KEY = ["key", "low", "high"]
PROMISING = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("component", pa.int64()), ("partners", pa.int64())])


def _promising(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of blocks with a partner that may be linked: sizes, components and whole signatures allow it, and no earlier key has the pair.

    Rows come sorted by block, then by n_shingles; each is compared with the 1st, 2nd, ... row behind it for all blocks at once.
    """
    for table, first in whole_groups(batches, BLOCK_KEY):
        col = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
        n, comp, parts, at, two = col("n_shingles"), col("component"), col("part"), col("at"), col("low") != col("high")
        rows = table.num_rows
        end = np.repeat(first[1:], np.diff(first)) if first[-1] == rows else np.repeat(np.append(first[1:], rows), np.diff(np.append(first, rows)))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(rows, SYMBOLS)
        keys = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.int64).reshape(rows, len(KEEP))
        earlier = np.arange(len(KEEP)) < at[:, None]
        partners, i, step = np.zeros(rows, np.int64), np.arange(rows), 0
        while True:
            step += 1
            i = i[i + step < end[i]]
            i = i[n[i + step] * 4 <= n[i] * 5]  # sizes within a factor of 0.8; later rows are larger still
            if not len(i):
                break
            a, b = i, i + step
            ok = (comp[a] != comp[b]) & ~(two[a] & (parts[a] == parts[b]))
            a, b = a[ok], b[ok]
            ok = ~((keys[a] == keys[b]) & earlier[a]).any(1)
            a, b = a[ok], b[ok]
            ok = (sketch[a] == sketch[b]).sum(1) >= AGREE
            np.add.at(partners, a[ok], 1)
            np.add.at(partners, b[ok], 1)
        hit = np.flatnonzero(partners)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col("key")[hit], col("id")[hit], comp[hit], partners[hit])], schema=PROMISING)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks with 100 * intersection >= 80 * union on full sets; between two known components one link is enough."""
    for table, first in whole_groups(batches, BLOCK_KEY):
        out = []
        bounds = first if first[-1] == table.num_rows else np.append(first, table.num_rows)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            g = table.slice(lo, hi - lo)
            out += _confirm_block(g.column("id").to_numpy(), g.column("component").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("shingles")])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=LINKS)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(large) * 4 > len(small) * 5:
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _confirm_star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members with their leader, on full sets. Rows come sorted by (leader, salt), the leader's own before its members."""
    now, centre = None, []
    for batch in batches:
        out = []
        for leader, salt, id_, member, shingles in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4), strict=True):
            if (leader, salt) != now:
                now, centre = (leader, salt), []
            own = np.frombuffer(shingles.as_buffer(), np.uint64)
            if not member:
                centre.append(own.copy())
            elif any(_similar(own, c) for c in centre):
                out.append((id_, leader))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=LINKS)


def _confirm_block(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids, comp, sizes, sets = ids[order].tolist(), comp[order].tolist(), sizes[order], [sets[i] for i in order]
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []

    def link(i: int, j: int) -> None:
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))

    if len(ids) <= 4:
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if find(comp[i]) != find(comp[j]) and _similar(sets[i], sets[j]):
                    link(i, j)
        return out
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    for i in range(len(ids) - 1):
        to = int(np.searchsorted(sizes * 4, sizes[i] * 5, "right"))
        if to <= i + 1:
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] : starts[to]]], starts[i + 1 : to] - starts[i + 1])
        mark[own] = 0
        for j in np.flatnonzero(100 * both >= 80 * (sizes[i] + sizes[i + 1 : to] - both)).tolist():
            link(i, i + 1 + j)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, by alternating large and small stars until nothing changes."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    while size[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = materialize(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select("u", "m")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == size:
            break
        size = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Deal the members of each key (key, id, component) that holds several components to pairs of blocks of about ``size`` members, so a group of any size is many bounded tasks.

    The members of a key's largest component aren't compared with each other: they only meet those of other components. Adds part, low and high.
    """
    dealt = rows.join(materialize(_shapes(rows).filter(F.col("rest") > 0)), "key")
    is_main, blocks = F.col("component") == F.col("main"), lambda n: F.ceil(F.col(n) / size).cast("int")
    dealt = dealt.withColumn("rest", blocks("rest")).withColumn("mains", blocks("of_main"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    dealt = dealt.withColumn("part", F.when(is_main, F.col("rest") + spread("mains")).otherwise(spread("rest")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(is_main, 0).otherwise(F.col("mains")))))
    dealt = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    return dealt.drop("other", "rest", "mains", "main", "of_main")


def _shapes(rows: DataFrame) -> DataFrame:
    """(key, main, of_main, rest): the largest component of each key, its members and those of others."""
    each = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("of_main"), (F.sum("n") - F.max("n")).alias("rest"))


def _by_block(rows: DataFrame, then: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, then)


def near_duplicates(df: DataFrame, shingle_words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    Linked: 100 * intersection >= 80 * union of the shingle sets. component_id: smallest doc_id reachable. Null and empty texts and texts
    without words have no shingles and are linked with nothing. Rows that repeat an id are one document, linked if one of their
    texts is. Rows with a null id are linked with nothing and kept, with component_id null. Other columns aren't read.
    """
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), whole_text(df[text]).alias("text"))
    sketched = materialize(docs.mapInArrow(_sketches(shingle_words), SKETCH))
    # equal sets are one class, named by its smallest id
    known = sketched.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(known.groupBy("set1", "set2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    first = known.join(classes.select("set1", "set2", F.col("id").alias("doc_id")), ["set1", "set2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set1", "set2"])
    first = materialize(first.select(F.col("doc_id").alias("id"), "n_shingles", "sketch", "packed", "keys"))
    payload = first.drop("keys")

    def keyed(component: DataFrame, at: Iterable[int]) -> DataFrame:
        """(id, component, at, key) for some of the keys; only these move until blocks are dealt."""
        chosen = F.array(*[F.struct(F.lit(i).alias("at"), F.col("keys")[i].alias("key")) for i in at])
        rows = first.join(component, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.explode(chosen).alias("k"))
        return rows.select("id", "component", "k.at", "k.key")

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = marked(docs, "doc_id", ids, "id").filter("_maybe").select("doc_id", "text")
        texts = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi")
        return texts.mapInArrow(_sets(shingle_words), "id long, shingles binary").filter(F.length("shingles") > 0)

    def led(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """Links of each id with the leader it shares most keys with, and the pairs compared. A key's leader is the member whose id has the smallest hash."""
        leaders = rows.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64(F.lit(seed), "id")).alias("leader"), F.min("component").alias("a"), F.max("component").alias("b"))
        leaders = materialize(leaders.filter("a < b").select("key", "leader"))
        pairs = rows.join(leaders, "key").filter("component <> leader.component").groupBy("id", F.col("leader.id").alias("leader")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEADER_SHARED)
        pairs = materialize(pairs.groupBy("id").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader")))
        sets = materialize(sets_of(pairs.select("id").union(pairs.select("leader")).distinct()))
        parts = materialize(pairs.groupBy("leader").agg(F.ceil(F.count("*") / CONFIRM_BLOCK).cast("int").alias("parts")))
        own = pairs.join(parts, "leader").join(sets, "id").select("leader", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), "id", F.lit(True).alias("member"), "shingles")
        centre = parts.join(sets, F.col("leader") == F.col("id")).select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "id", F.lit(False).alias("member"), "shingles")
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = own.unionByName(centre).repartition(n, "leader", "salt").sortWithinPartitions("leader", "salt", "member")
        return materialize(dealt.mapInArrow(_confirm_star, "a long, b long")), pairs

    def promising(component: DataFrame) -> DataFrame:
        rows = _blocks(keyed(component, range(len(KEEP))), BLOCK).join(payload, "id")
        dealt = _by_block(rows.select(*BLOCK_KEY, "id", "at", "component", "part", "n_shingles", "sketch", "packed"), "n_shingles")
        return dealt.mapInArrow(_promising, "key long, id long, component long, partners long")

    def confirmed(found: DataFrame) -> DataFrame:
        rows = _blocks(found, CONFIRM_BLOCK).join(sets_of(found.select("id").distinct()), "id").select(*BLOCK_KEY, "id", "component", "shingles")
        return _by_block(rows, "id").mapInArrow(_confirm, "a long, b long")

    links = component = None
    none = df.sparkSession.createDataFrame([], "id long, component long")
    for seed in range(LEADER_ROUNDS):
        rows = keyed(none if component is None else component, LEADER_KEYS)
        if not _shapes(rows).filter((F.col("rest") > 0) & (F.col("of_main") + F.col("rest") > BLOCK)).limit(1).count():
            break
        found, compared = led(rows, seed)
        links = found if links is None else links.union(found)
        component = connected_components(links)
        if 2 * found.count() < compared.count():
            break
    # then all blocks that still hold several components
    left = materialize(promising(none if component is None else component).select("key", "id", "component").distinct())
    if left.limit(1).count():
        found = materialize(confirmed(left))
        component = connected_components(found if links is None else links.union(found))
    component = none if component is None else component
    named = classes.select("set1", "set2", "id").join(component, "id", "left").select("set1", "set2", F.coalesce("component", "id").alias("component"))
    named = materialize(named)
    # ids with several texts carry their smallest component along
    out = sketched.select("doc_id", "n_shingles", "set1", "set2").join(named, ["set1", "set2"], "left")
    component_id = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(df: DataFrame, shingle_words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns: of each component the smallest doc_id."""
    gone = free_name(df, "dropped")
    dropped = near_duplicates(df, shingle_words, doc_id, text).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return df.join(dropped, df[doc_id].cast("long") == dropped[gone], "left_anti")

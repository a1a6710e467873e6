"""Merkle manifest of a dataset, level by level through windows.

Leaves are numbered within their group by a range sort. At each level a window over (group, parent index) collects all nodes of a run, in order, on each of its rows: that
list is both the parent's preimage and, without the row's own node, its siblings. One row of each run goes on as the parent. The roots of the groups are the
leaves of one more tree. Then paths (place and siblings of each level) are handed down from runs to their nodes, so a path is joined once for each run and not for each leaf.
Built-in functions only; no group or level meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 8


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 length in bytes, ':' and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def numbered(rows: DataFrame, group: str, sort: list[str]) -> DataFrame:
    """``rows`` with idx, from 0 within each group in the order of ``sort``, and n, the rows of the group; written.

    Places come from a range sort and the counts of its partitions, so a group may be of any size.
    """
    order = [group, *sort]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    # a row for each partition and each group that begins in it
    runs = ordered.groupBy(F.col(group).alias("_group"), F.col("part").alias("_part")).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("here").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("_group", "_part", (before - F.col("first")).alias("shift"), F.sum("here").over(W.partitionBy("_group")).alias("n")))
    joined = ordered.join(runs, (F.col(group) == F.col("_group")) & (F.col("part") == F.col("_part")))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


def _climb(nodes: DataFrame, node: Column, fanout: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Runs of each level (group, parent, members), the nodes without siblings on each level, and the top of each group (group, top).

    ``nodes``: group, idx, n and what ``node``, a struct with digest, is made of.
    """
    runs, alone, tops = [], [], []
    while True:
        single = nodes.filter("n = 1")
        alone.append(single.select("group", node.alias("node")))
        tops.append(single.select("group", F.col("digest").alias("top")))
        rest = nodes.filter("n > 1").withColumn("parent", F.expr(f"idx div {fanout}"))
        run = W.partitionBy("group", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        level = rest.withColumn("members", F.collect_list(node).over(run)).filter(f"idx % {fanout} = 0")  # one row of each run goes on
        level = materialize(level.select("group", "parent", "members", "n", digest(F.array_join(F.col("members.digest"), "")).alias("digest")))
        if not level.limit(1).count():
            break
        runs.append(level.select("group", "parent", "members"))
        nodes = level.select("group", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), "digest")
        node = F.struct("digest")
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return runs, alone, materialize(top)


STEP = "array<struct<at:int,siblings:array<string>>>"


def _descend(runs: list[DataFrame], alone: list[DataFrame], tops: DataFrame) -> DataFrame:
    """group, node, top, path of each leaf. ``tops``: group, top and the path from there on."""
    paths = None
    for k in reversed(range(len(alone))):
        own = alone[k].join(tops, "group").select("group", F.lit(0).cast("long").alias("idx"), "node", "top", "path")
        if k < len(runs):
            above = paths.select(F.col("group").alias("_group"), F.col("idx").alias("_idx"), "top", "path")
            met = runs[k].join(above, (F.col("group") == F.col("_group")) & (F.col("parent") == F.col("_idx")))
            met = met.select("group", "parent", "top", "path", F.col("members.digest").alias("digests"), F.posexplode("members").alias("at", "node"))
            others = F.filter("digests", lambda x, i: i != F.col("at"))
            step = F.array(F.struct("at", others.alias("siblings"))).cast(STEP)
            below = met.select("group", (F.col("parent") * FANOUT + F.col("at")).alias("idx"), "node", "top", F.concat(step, "path").alias("path"))
            own = own.unionByName(below)
        paths = own
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(h: Column, step: Column) -> Column:
        return digest(F.array_join(F.slice(step["siblings"], F.lit(1), step["at"]), ""), h, F.array_join(F.slice(step["siblings"], step["at"] + 1, F.lit(FANOUT)), ""))

    return F.aggregate(path, leaf, up)


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda s: s["siblings"]))


def manifest(df: DataFrame, group: Column, order: list[str], leaf: Column, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``df`` with ``carry``, leaf, subroot, root and path; and the groups with their subroots.

    The nodes of each group, in the order of ``order`` (null first; then leaf, then any order of rows that are the same), are hashed eight at a time, also a last run of one, until one remains: the subroot (a lone leaf itself). Groups,
    null first and then bytewise, give the root likewise. path: place and siblings from the leaf to the root. An empty table has no rows and no root.
    """
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = df.select(key.alias("group"), leaf.alias("digest"), F.struct(*carry).alias("more"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("row"))
    leaves = numbered(rows, "group", [*[f"order{i}" for i in range(len(order))], "digest", "row"])
    node = F.struct("digest", "more")
    runs, alone, tops = _climb(leaves.select("group", "idx", "n", "digest", "more"), node, FANOUT)
    upper = numbered(tops.select(F.lit("").alias("group"), F.col("top").alias("digest"), F.col("group").alias("name")), "group", ["name"])
    above, lone, root = _climb(upper.select("group", "idx", "n", "digest", "name"), F.struct("digest", "name"), FANOUT)
    found = root.first()  # one row: the root
    root_paths = root.withColumn("path", F.array().cast(STEP))
    groups = materialize(_descend(above, lone, root_paths).select(F.col("node.name").alias("group"), F.col("node.digest").alias("top"), "path"))
    out = _descend(runs, alone, groups)
    out = out.select("node.more.*", F.col("node.digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(found.top if found else None).cast("string").alias("root"), "path")
    return out, groups


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, and tampered, the leaf with the text's A-Z in lower case where 3 divides the crc32 of the id, else null.

    Null fields are '-'; null ids sort first and are never tampered with; repeated rows are leaves of their own; other columns aren't read.
    """
    low = F.translate(df["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [df[c] for c in FIELDS]
    hit = F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 0
    docs = df.select(df["doc_id"].alias("doc_id"), df["lang"].alias("lang"), digest(*map(field, fields)).alias("leaf"), F.when(hit, digest(*map(field, [*fields[:-1], low]))).alias("tampered"))
    return manifest(docs, F.col("lang"), ["doc_id"], F.col("leaf"), ["doc_id", "tampered"])[0]


def proofs(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified from ``document_manifest``."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = df.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("path")), ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg).

A text is cut into blocks of fixed size in bytes. The distinct blocks are sorted and numbered,
so every block has an integer name that equals another's only if their bytes do. Adjacent names are
then paired and the pairs named in turn, until each document has one name: its identity, free of
collisions. Only integers move after the first level. Names and groups are written before they are joined back, so both sides of
these joins are plain exchanges and a key that very many rows share is split among tasks.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, whole_text

BLOCK_BYTES = 1024


def _blocks(n_bytes: str, data: str, size: int):
    last = F.greatest(F.ceil(F.col(n_bytes) / size), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(F.col(data), (i * size + 1).cast("int"), F.lit(size)))


def _named_blocks(df: DataFrame, text: str, size: int, salt: int) -> DataFrame:
    """(h1, h2, name): distinct blocks, sorted within hash partitions and numbered; one row per content."""
    data = df.select(whole_text(df[text]).cast("binary").alias("data")).withColumn("n", F.octet_length("data"))
    block = data.select(F.explode(_blocks("n", "data", size)).alias("block"))
    key = [F.xxhash64(F.lit(salt), "block").alias("h1"), F.xxhash64(F.lit(salt + 1), "block").alias("h2")]
    distinct = block.select(*key, "block").distinct().sortWithinPartitions("block")
    return materialize(distinct.select("h1", "h2", F.monotonically_increasing_id().alias("name")))


def block_identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: row, doc_id, n_bytes, text_sha256 and identity.

    Two rows have the same (n_bytes, identity) exactly if their texts have the same bytes. A null text
    counts as empty; an empty text is one empty block. doc_id may be null or repeated.
    """
    for salt in count(0, 2):
        names = _named_blocks(df, text, block_bytes, salt)
        # names are looked up by two 64-bit hashes; should two contents share both, hash again with another salt
        if names.groupBy("h1", "h2").count().filter("count > 1").limit(1).count() == 0:
            break
    data = df.select(df[doc_id].alias("doc_id"), whole_text(df[text]).cast("binary").alias("data")).withColumn("n_bytes", F.octet_length("data").cast("long"))
    hashes = F.transform(_blocks("n_bytes", "data", block_bytes), lambda b: F.struct(F.xxhash64(F.lit(salt), b).alias("h1"), F.xxhash64(F.lit(salt + 1), b).alias("h2")))
    docs = materialize(data.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", F.sha2("data", 256).alias("text_sha256"), hashes.alias("hashes")))

    first = docs.select("row", F.size("hashes").cast("long").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    first = first.select("row", "n", F.col("pos").cast("long"), F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    level = materialize(first.join(names, ["h1", "h2"]).select("row", "n", "pos", "name", F.monotonically_increasing_id().alias("occurrence")))
    finished = [level.filter("n = 1").select("row", "name")]
    longest = docs.agg(F.max(F.size("hashes"))).first()[0] or 1
    while longest > 1:
        even = F.col("pos") % 2 == 0
        pairs = materialize(level.filter("n > 1").groupBy("row", "n", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.min("occurrence").alias("occurrence"),
        ))
        # a pair's name is the place of its first occurrence: unique for each pair of names
        named = materialize(pairs.groupBy("left", "right").agg(F.min("occurrence").alias("name")))
        level = materialize(pairs.join(named, ["left", "right"]).select("row", F.expr("(n + 1) div 2").alias("n"), "pos", "name", "occurrence"))
        finished.append(level.filter("n = 1").select("row", "name"))
        longest = (longest + 1) // 2
    identity = reduce(DataFrame.unionByName, finished).withColumnRenamed("name", "identity")
    return docs.drop("hashes").join(identity, "row")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays (null ids are smallest); of
    rows that repeat an id and a text, one. Null and empty texts are equal. Other columns of ``df`` aren't read.
    An empty table gives an empty result.
    """
    docs = materialize(block_identities(df, doc_id, text, block_bytes))
    groups = materialize(docs.groupBy("n_bytes", "identity").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")))
    out = docs.join(groups, ["n_bytes", "identity"])
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with their columns.

    Of rows that repeat both id and text, one stays (other columns: any one of theirs).
    """
    kept = exact_dedup(df, doc_id, text, block_bytes)
    key, digest, rows = (free_name(df, n) for n in ("kept_id", "kept_sha256", "kept_rows"))
    keys = kept.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest)).agg(F.max("kept").alias("any"), F.count("*").alias(rows)).filter("any").drop("any")
    sha = F.sha2(whole_text(df[text]).cast("binary"), 256)
    joined = df.join(keys, df[doc_id].eqNullSafe(keys[key]) & (sha == keys[digest]), "inner")
    names = df.columns
    single = joined.filter(F.col(rows) == 1).select(*names)
    if keys.filter(F.col(rows) > 1).limit(1).count() == 0:
        return single
    return single.unionByName(joined.filter(F.col(rows) > 1).dropDuplicates([key, digest]).select(*names))

"""Sharding by a hierarchical weighted hash tree.

Every shard draws a straw ln(u) / weight, with u hashed from the key and the shard's name. The straw of a rack is the longest of its
shards', that of a region the longest of its racks', which is how a draw of the summed weight is distributed. A key descends from
the root to the region, rack and shard whose straw is longest. A draw depends on its own shard's name and weight only, so a changed weight
moves keys into or out of that shard alone, and a new shard takes keys without moving any between older ones. Put plainly: because a node's straw is that of a leaf
below it, the descent ends where one flat draw among all shards would, and a row costs a hash for each shard. Draws of a node's own would be cheaper, but a changed
weight would then also move keys between the shards below that node, against the law.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 3


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(n_shards: int) -> list[Shard]:
    """Shards of weight 1, four to a rack and three racks to a region."""
    return [Shard(i // (SHARDS_PER_RACK * RACKS_PER_REGION), i // SHARDS_PER_RACK, i) for i in range(n_shards)]


def _straw(key: Column, shard: Shard) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":shard{shard.shard}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.struct((F.log(u) / shard.weight).alias("straw"), F.lit(shard.shard).alias("shard"))


def _longest(straws: list[Column]) -> Column:
    return F.greatest(*straws) if len(straws) > 1 else straws[0]


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key (a string column; null reads as 'null'). A row costs one hash for each shard."""
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("a tree needs shards, and their weights must be positive")
    key = F.coalesce(key, F.lit("null"))

    def rack(region: int, name: int) -> Column:
        return _longest([_straw(key, s) for s in tree if (s.region, s.rack) == (region, name)])

    def region(name: int) -> Column:
        return _longest([rack(name, r) for r in sorted({s.rack for s in tree if s.region == name})])

    return _longest([region(r) for r in sorted({s.region for s in tree})])["shard"]


def shard_documents(df: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row and number the rows of each shard from 0, by doc_id.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot and grown_shard (null without ``grown``).
    Null text: no bytes. Rows with a null id share one shard; repeated rows get slots of their own. Slots come from
    a range sort by (shard, doc_id) and the counts of its partitions, so no shard has to fit into one task.
    """
    key = df[doc_id].cast("string")
    body = whole_text(df[text]).cast("binary")
    placed = df.select(
        df[doc_id].alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    sort = ["shard", "doc_id", "size", "text_crc32"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(placed.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    from pyspark.sql import Window as W

    # at most one row for each partition and each shard that begins in it
    runs = ordered.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("shard").alias("_shard"), "part", (before - F.col("first")).alias("shift"))
    out = ordered.withColumn("_part", part).join(F.broadcast(runs), (F.col("shard") == F.col("_shard")) & (F.col("_part") == F.col("part")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")

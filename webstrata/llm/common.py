"""Helpers shared by the training-data operators: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CACHES: list = []


def only_cache(cache) -> None:
    """Empty the word caches of other operators in this Python worker, so their sizes don't add up."""
    if not any(c is cache for c in _CACHES):
        _CACHES.append(cache)
    for c in _CACHES:
        if c is not cache:
            c.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies in spark.checkpoint.dir. Only where that is unset and Spark runs on one machine (tests)
    a local folder is made and set for the session; a cluster needs the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webstrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    Lost executors then cost a reread, and columns such as monotonically_increasing_id()
    have one value for all later uses.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``materialize`` once nothing reads it any more."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del jvm


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null read as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BITS = 1 << 23


def with_bit(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the place of a key in a bitmap of BITS bits: columns _word and _bit."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    return rows.withColumn("_word", F.floor(at / 64).cast("int")).withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")))


def marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` with _maybe: false only if ``wanted`` doesn't have the key; null keys: false.

    What goes to all tasks is a bitmap of at most BITS / 64 rows, however many keys are wanted, so a join that follows shuffles little but the rows it needs.
    """
    bitmap = with_bit(wanted.select(wanted_key), wanted_key).groupBy(F.col("_word").alias("_w")).agg(F.bit_or("_bit").alias("_bits"))
    out = with_bit(rows, key).join(F.broadcast(bitmap), F.col("_word") == F.col("_w"), "left")
    maybe = F.col(key).isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return out.withColumn("_maybe", maybe).select(*rows.columns, "_maybe")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]

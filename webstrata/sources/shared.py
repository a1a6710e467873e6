"""Folders that the driver and all executors share, and results written there to end their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a local one is made and set, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webstrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a round's result and read it back, so lineage stays short and lost executors cost a reread."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once_each(df: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``make`` adds to rows of ``keys``, worked out once for each different set of them (nulls too) and not once a row.

    Their table is written first, so its size is known: a small one is broadcast, any other is joined by a shuffle.
    """
    table = make(df.select(*keys).distinct())
    added = [c for c in table.columns if c not in keys]
    table = cut(table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *added))
    return df.join(table, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])).select(*df.columns, *added)


def put(df: DataFrame, folder: str, n: int) -> DataFrame:
    """Write round ``n`` of an iteration below its folder and read that round back."""
    df.write.parquet(f"{folder}/round={n}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/round={n}")


def all_rounds(like: DataFrame, folder: str) -> DataFrame:
    """All rounds written so far; nothing is written again."""
    return like.sparkSession.read.schema(like.schema).parquet(f"{folder}/round=*")

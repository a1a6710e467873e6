"""Structured Streaming forms of the stateful services: watches, replay misses, pressure and log counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules


def excerpt(text: str | None) -> tuple[str, str]:
    """Hash and beginning of a watched text, its white space made even; null is empty."""
    plain = re.sub(r"\s+", " ", text if isinstance(text, str) else "").strip()
    return hashlib.sha256(plain.encode()).hexdigest(), plain[:120]


def watch_notifications(observations: DataFrame) -> DataFrame:
    """(watch_id, ts, before, now) on each change of watched text; the first observation of a watch is its baseline.

    observations(watch_id, ts, text) is a stream; the last hash and excerpt of each watch are the state. Of rows of a watch in one batch the earlier is
    compared first; null texts are empty.
    """

    def compare(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        rows, out = pd.concat(list(batches)).sort_values("ts"), []
        for ts, text in zip(rows["ts"], rows["text"], strict=True):
            digest, shown = excerpt(text)
            if last[0] is not None and digest != last[0]:
                out.append((key[0], ts, last[1], shown))
            last = (digest, shown)
        state.update(last)
        yield pd.DataFrame(out, columns=["watch_id", "ts", "before", "now"])

    return observations.groupBy("watch_id").applyInPandasWithState(compare, "watch_id string, ts timestamp, before string, now string", "hash string, shown string", "append", GroupStateTimeout.NoTimeout)


def miss_counts(misses: DataFrame) -> DataFrame:
    """Running (url, n, first_seen, last_seen) of a stream of replay misses (url, ts); for update mode."""
    return misses.groupBy("url").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merge_into(path: str):
    """foreachBatch function that keeps the latest counts of each URL as Parquet, by batch number: a batch that comes again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return merge


def read_merged(spark, path: str) -> DataFrame:
    latest = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return latest.groupBy("url").agg(F.max_by(F.struct("n", "first_seen", "last_seen"), "batch_id").alias("m")).select("url", "m.*")


def pressure_stream(metrics: DataFrame) -> DataFrame:
    """Each sample (ts, cpu, memory, disk, network, gpu) with its pressure and limits."""
    level = rules.pressure(*[F.col(c) for c in ("cpu", "memory", "disk", "network", "gpu")])
    return metrics.select("ts", level.alias("pressure"), rules.adapted_limit(level, 4).alias("capture"), rules.adapted_limit(level, 8).alias("discovery"))


def windowed_log_counts(log: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, level, n) of a log stream; rows later than ``late`` are left to the watermark. An addition of this engine: the services count over all time."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "level").agg(F.count("*").alias("n"))

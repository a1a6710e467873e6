"""Metrics, logs, schedules, watches, batches and replay reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text, urls


def cpu_usage(samples: DataFrame) -> DataFrame:
    """(host, ts, percent): share of busy time between two cumulative samples (host, ts, idle, total); null without progress."""
    w = W.partitionBy("host").orderBy("ts")
    total, idle = F.col("total") - F.lag("total").over(w), F.col("idle") - F.lag("idle").over(w)
    return samples.select("host", "ts", F.when((total > 0) & (idle >= 0), rules.clamp_percent((1 - idle / total) * 100)).alias("percent"))


def counter_reduction(counters: DataFrame) -> DataFrame:
    """(ts, kind, value): counters of each engine added up, then the busiest engine. counters(ts, kind, engine, value)."""
    return counters.groupBy("ts", "kind", "engine").agg(F.sum("value").alias("v")).groupBy("ts", "kind").agg(F.max("v").alias("value"))


def tail(log: DataFrame, n: int, order: str = "ts", tie: str = "sequence") -> DataFrame:
    """The last ``n`` records in ascending order."""
    return log.orderBy(F.desc(order), F.desc(tie)).limit(n).orderBy(order, tie)


def number_events(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    return log.withColumn("sequence", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def log_counts(log: DataFrame) -> DataFrame:
    """(key, n): events by level:component.event."""
    return log.groupBy(F.concat(F.col("level"), F.lit(":"), F.col("component"), F.lit("."), F.col("event")).alias("key")).agg(F.count("*").alias("n"))


def expired_days(days: DataFrame, today: Column, keep: int = 7) -> DataFrame:
    """Day partitions older than ``keep`` days."""
    return days.filter(F.datediff(today, F.col("day")) >= keep)


def merge_misses(old: DataFrame, new: DataFrame, cap: int = 2000) -> DataFrame:
    """(url, n, first_seen, last_seen, total): misses of replay added up; at most ``cap`` URLs are listed, old ones first, but all count in the total."""
    rows = old.select("url", "n", "first_seen", "last_seen", F.lit(0).alias("new")).unionByName(new.select("url", "n", "first_seen", "last_seen", F.lit(1).alias("new")))
    out = rows.groupBy("url").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("new").alias("new"))
    total = rows.agg(F.sum("n").alias("total"))  # one row
    return out.orderBy("new", "first_seen", "url").limit(cap).drop("new").crossJoin(F.broadcast(total))


def watch_changes(observations: DataFrame, history: int = 20) -> DataFrame:
    """(watch_id, ts, hash, excerpt, changed, kept): the first observation of a watch is its baseline; later ones are compared with the one before.

    observations(watch_id, ts, text). kept: among the last ``history`` entries of the watch's history (baseline and changes).
    """
    w = W.partitionBy("watch_id").orderBy("ts")
    rows = observations.withColumn("hash", F.sha2(text.watch_text(F.col("text")), 256)).withColumn("before", F.lag("hash").over(w))
    rows = rows.withColumn("changed", F.coalesce(F.col("hash") != F.col("before"), F.lit(False))).withColumn("entry", F.col("changed") | F.col("before").isNull())
    newest = F.sum(F.col("entry").cast("int")).over(W.partitionBy("watch_id").orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select("watch_id", "ts", "hash", text.excerpt(F.col("text")).alias("excerpt"), "changed", (F.col("entry") & (newest <= history)).alias("kept"))


def due(items: DataFrame, now: Column) -> DataFrame:
    return items.filter("enabled and not running").filter(F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))


def next_run(frequency: Column, hour: Column, minute: Column, weekday: Column, start: Column) -> Column:
    """The next run after ``start`` of an hourly, daily or weekly schedule (weekday 0 is Sunday), in the session's time zone."""
    minutes = lambda base, h, m: base + F.make_dt_interval(F.lit(0), h, m)
    zero = F.lit(0)
    hourly = minutes(F.date_trunc("hour", start), zero, minute)
    hourly = F.when(hourly <= start, hourly + F.expr("interval 1 hour")).otherwise(hourly)
    at = minutes(F.date_trunc("day", start), hour, minute)
    daily = F.when(at <= start, at + F.expr("interval 1 day")).otherwise(at)
    days = F.pmod(weekday - (F.dayofweek(start) - 1), F.lit(7))
    days = F.when((days == 0) & (at <= start), 7).otherwise(days)
    weekly = at + F.make_dt_interval(days)
    return F.when(frequency == "hourly", hourly).when(frequency == "daily", daily).when(frequency == "weekly", weekly)


def describe_diff(added: Column, changed: Column, removed: Column) -> Column:
    some = F.format_string("前回から 追加%dページ・変更%dページ・削除%dページ。", added, changed, removed)
    return F.when(added.isNull(), "前回との比較はできませんでした。").when(added + changed + removed == 0, "前回から変わったページはありません。").otherwise(some)


def batch_summary(entries: DataFrame) -> DataFrame:
    """(batch_id, total, pending, running, done, failed): entries (batch_id, status) by state."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return entries.groupBy("batch_id").agg(F.count("*").alias("total"), n("pending").alias("pending"), n("running").alias("running"), n("complete", "complete-with-errors").alias("done"), n("failed", "blocked", "login-required").alias("failed"))


def advance_batches(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Entries (batch_id, ordinal, job_id, status) after one step: ended jobs are noted, then the first pending entry of an idle batch starts."""
    ended = ["complete", "complete-with-errors", "cancelled", "limit-reached", "failed", "blocked", "login-required"]
    now = entries.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id", "left")
    status = F.when((F.col("status") == "running") & F.col("job_status").isin(ended), F.col("job_status")).otherwise(F.col("status"))
    now = now.withColumn("status", status)
    state = now.groupBy("batch_id").agg(F.max(F.col("status") == "running").alias("busy"), F.min(F.when(F.col("status") == "pending", F.col("ordinal"))).alias("next"))
    starts = ~F.col("busy") & (F.col("ordinal") == F.col("next"))
    return now.join(state, "batch_id").select("batch_id", "ordinal", "job_id", F.when(F.coalesce(starts, F.lit(False)), "running").otherwise(F.col("status")).alias("status"))


def url_list(lines: DataFrame) -> DataFrame:
    """(list_id, url, valid, place) from pasted text (list_id, text): words between spaces and commas; a URL once, at its first place."""
    words = lines.select("list_id", F.posexplode(F.filter(F.split("text", r"[\s,]+"), lambda w: w != "")).alias("place", "word"))
    href = urls.parts(F.col("word"))
    rows = words.withColumn("ok", href["href"].isNotNull()).withColumn("url", F.when(F.col("ok"), F.concat(href["href"], href["fragment"])).otherwise(F.substring("word", 1, 200)))
    once = rows.groupBy("list_id", "ok", "url", F.when(~F.col("ok"), F.col("place")).alias("own")).agg(F.min("place").alias("place"))
    return once.select("list_id", "url", F.col("ok").alias("valid"), "place")


def replay_summary(pages: DataFrame) -> DataFrame:
    """One row: states of replayed pages, sums of their counters and the mean similarity. pages(status, similarity, counters...)."""
    sums = [c for c, t in pages.dtypes if t in ("int", "bigint") and c not in ("page_id",)]
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_pages")
    mean = (F.floor(F.avg("similarity") * 1000 + 0.5) / 1000).alias("visual_average")
    return pages.agg(F.count("*").alias("total_pages"), n("healthy"), n("warning"), n("error"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.count("similarity").alias("visual_compared"), F.count_if(F.col("similarity") < 0.9).alias("visual_mismatches"), mean)


def visual_pages(audit: DataFrame, limit: int = 200) -> DataFrame:
    """Compared pages, least similar first, unknown ones last."""
    return audit.select("url", "similarity", F.coalesce(F.col("similarity") < 0.9, F.lit(False)).alias("mismatch")).orderBy(F.asc_nulls_last("similarity"), "url").limit(limit)


def visual_grid(pixels: DataFrame, sample: int = 4, threshold: float = 0.08) -> DataFrame:
    """(image_id, cells, changed, similarity) from pixel pairs (image_id, x, y, r1, g1, b1, r2, g2, b2): cells whose mean difference passes the threshold."""
    difference = (F.abs(F.col("r1") - F.col("r2")) + F.abs(F.col("g1") - F.col("g2")) + F.abs(F.col("b1") - F.col("b2"))) / 765
    cell = pixels.groupBy("image_id", F.floor(F.col("x") / sample).alias("gx"), F.floor(F.col("y") / sample).alias("gy")).agg(F.avg(difference).alias("d"))
    out = cell.groupBy("image_id").agg(F.count("*").alias("cells"), F.count_if(F.col("d") > threshold).alias("changed"))
    return out.withColumn("similarity", F.floor((1 - F.col("changed") / F.col("cells")) * 1000 + 0.5) / 1000)


def host_gaps(requests: DataFrame, interval_ms: int) -> DataFrame:
    """Requests (host, ts) that came sooner after the one before than the interval allows, with the gap."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(W.partitionBy("host").orderBy("ts"))
    return requests.withColumn("gap_ms", F.round(gap / 1000).cast("long")).filter(F.col("gap_ms") < interval_ms)


def stalled(updates: DataFrame, seconds: int = 180) -> DataFrame:
    """(job_id, ts, gap): the first time each job was silent for ``seconds`` between two updates (job_id, ts)."""
    after = F.lead("ts").over(W.partitionBy("job_id").orderBy("ts"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gaps = updates.withColumn("gap", micros(after) - micros(F.col("ts"))).filter(F.col("gap") >= seconds * 1_000_000)
    return gaps.groupBy("job_id").agg(F.min_by(F.struct("ts", "gap"), "ts").alias("g")).select("job_id", "g.ts", (F.col("g.gap") / 1e6).alias("gap"))


def stage_timings(stages: DataFrame) -> DataFrame:
    """(job_id, stage, ms): time from each stage (job_id, stage, ts) to the one before."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return stages.select("job_id", "stage", ((at - F.lag(at).over(W.partitionBy("job_id").orderBy("ts"))) / 1000).alias("ms"))


def spaced(times: DataFrame, gap_us: int, most: int | None = None) -> DataFrame:
    """(kind, n, ts): of the times (kind, ts) of each kind, the first and then each one at least ``gap_us`` behind the last accepted; ``most`` of a kind.

    Sorted times stream through a task, which keeps the last accepted one only.
    """
    at = times.select(F.col("kind").cast("string").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).filter("us is not null")
    at = at.distinct() if gap_us > 0 else at

    def accept(batches):
        import pyarrow as pa

        now, last, n = None, None, 0
        for batch in batches:
            out = []
            for kind, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None or kind != now:
                    now, n = kind, 0
                elif us - last < gap_us or n == most:
                    continue
                if most is None or n < most:
                    out.append((kind, n, us))
                    last, n = us, n + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["kind", "n", "us"])

    found = at.repartition("kind").sortWithinPartitions("kind", "us").mapInArrow(accept, "kind string, n int, us long")
    return found.select("kind", "n", F.timestamp_micros("us").alias("ts"))


def tuner_reductions(errors: DataFrame, start: int, cooldown_seconds: float = 5.0) -> DataFrame:
    """(kind, ts, from, to): each accepted error lowers the limit by one; errors within the cool-down of the last accepted one don't count.

    errors(kind, ts); the limit bounds the accepted ones of a kind.
    """
    out = spaced(errors, int(cooldown_seconds * 1e6), max(0, start - 1))
    return out.select("kind", "ts", (F.lit(start) - F.col("n")).alias("from"), (F.lit(start) - F.col("n") - 1).alias("to"))


def latest_frames(frames: DataFrame, min_gap_ms: int = 200) -> DataFrame:
    """(job_id, slot, ts, frame): latest frame of each slot."""
    return frames.groupBy("job_id", "slot").agg(F.max_by(F.struct("ts", "frame"), F.struct("ts", "frame")).alias("f")).select("job_id", "slot", "f.ts", "f.frame")


def keep_newest(items: DataFrame, by: str | None, order: str, n: int) -> DataFrame:
    """The newest ``n`` items, of each group if there is one."""
    if by is None:
        return items.orderBy(F.desc(order)).limit(n)
    return items.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")

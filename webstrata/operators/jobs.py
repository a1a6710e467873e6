"""Jobs, notifications and capture state: listings, recovery, ledgers and choices between responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, urls
from .pages import first_by
from .services import spaced

ACTIVE = ["queued", "running", "discovering", "pausing", "capturing"]
TERMINAL = ["complete", "complete-with-errors", "cancelled", "limit-reached", "failed", "blocked", "login-required"]


def counts(jobs: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: jobs, active_jobs, archives."""
    of_jobs = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status").isin(ACTIVE)).alias("active_jobs"))
    return of_jobs.crossJoin(archives.agg(F.count("*").alias("archives")))  # one row each


def list_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest jobs first; at most 5000."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(max(1, min(5000, limit)))


def active_job(jobs: DataFrame) -> DataFrame:
    """The job to show: by state, then the one updated last."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("running", "capturing", "discovering", "warning", "pausing", "paused", "queued")]), F.col("status"))
    return jobs.filter(rank > 0).orderBy(rank, F.desc("updated_at"), "job_id").limit(1)


def recover(jobs: DataFrame, saved_pages: DataFrame) -> DataFrame:
    """Jobs after a crash: running ones pause, complete ones without a saved page have failed. saved_pages(archive_id, pages)."""
    rows = jobs.join(saved_pages, "archive_id", "left")
    empty = F.coalesce("pages", F.lit(0)) == 0
    status = F.when(F.col("status").isin(ACTIVE), "paused").when(F.col("status").isin("complete", "complete-with-errors") & empty, "failed").otherwise(F.col("status"))
    return rows.select("job_id", "archive_id", status.alias("status"))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(~F.coalesce("read", F.lit(False))).alias("unread"))


def add_notifications(old: DataFrame, new: DataFrame, keep: int = 200) -> DataFrame:
    """The newest ``keep`` of both."""
    return old.unionByName(new).orderBy(F.desc("at"), F.desc("id")).limit(keep)


def mark_read(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return notifications.join(hit, "id", "left").withColumn("read", F.coalesce("_hit", F.lit(False)) | F.coalesce("read", F.lit(False))).drop("_hit")


def retry_schedule(failures: DataFrame, delay_seconds: int) -> DataFrame:
    """(url, attempt, not_before): attempts of each URL are numbered and wait longer each time. failures(url, ts)."""
    n = F.row_number().over(W.partitionBy("url").orderBy("ts"))
    return failures.withColumn("attempt", n).select("url", "attempt", (F.col("ts") + F.make_dt_interval(secs=(F.col("attempt") * delay_seconds).cast("decimal(18,6)"))).alias("not_before"))


def ledger_tallies(retries: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return retries.groupBy("archive_id").agg(n("recovered"), n("failed"), n("waiting"))


def crawl_tree(visited: DataFrame, active: DataFrame, planned: DataFrame, queue: DataFrame, each: int = 80) -> DataFrame:
    """(url, state): the last visited, active, planned and waiting URLs (url, ordinal), ``each`` of them; active ones aren't listed as waiting."""
    part = lambda df, s, order: df.orderBy(order, "url").limit(each).select("url", F.lit(s).alias("state"))
    rest = lambda df: df.join(active.select("url"), "url", "left_anti")
    out = part(visited, "visited", F.desc("ordinal")).unionByName(part(active, "active", F.col("ordinal")))
    return out.unionByName(part(rest(planned), "planned", F.col("ordinal"))).unionByName(part(rest(queue), "waiting", F.col("ordinal")))


def filter_pages(pages: DataFrame, shared: DataFrame, query: str) -> DataFrame:
    """Pages and shared pages (url, title) whose URL or title holds the query."""
    both = pages.select("url", "title", F.lit(False).alias("shared")).unionByName(shared.select("url", "title", F.lit(True).alias("shared")))
    return both.filter(F.contains(F.lower(F.concat_ws(" ", "url", F.coalesce("title", F.lit("")))), F.lit(query.strip().lower())))


def network_busy(requests: DataFrame, now: Column, long_ms: int, idle_ms: int) -> DataFrame:
    """(page, busy): an open request younger than ``long_ms``, or activity within ``idle_ms``. requests(page, started, ended)."""
    ms = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1000
    opened = F.col("ended").isNull() & (ms(now, F.col("started")) < long_ms)
    recent = ms(now, F.coalesce("ended", "started")) < idle_ms
    return requests.groupBy("page").agg(F.max(opened | recent).alias("busy"))


def representatives(elements: DataFrame, per_group: int = 2, per_label: int = 40) -> DataFrame:
    """At most ``per_group`` elements of each structural group, one of each signature and ``per_label`` of each label, in order.

    elements(ordinal, label, group_key, signature).
    """
    once = first_by(elements, ["signature"], F.col("ordinal"))
    few = once.withColumn("_g", F.row_number().over(W.partitionBy("group_key").orderBy("ordinal"))).filter(F.col("_g") <= per_group)
    return few.withColumn("_l", F.row_number().over(W.partitionBy("label").orderBy("ordinal"))).filter(F.col("_l") <= per_label).drop("_g", "_l")


def new_variants(found: DataFrame, known: DataFrame, variants: DataFrame) -> DataFrame:
    """(archive_id, url, digest, state): bodies of known URLs with another digest: known-variant or new-variant."""
    other = found.join(known.select("archive_id", "url", F.col("digest").alias("_d")), ["archive_id", "url"]).filter(F.col("digest") != F.col("_d")).select("archive_id", "url", "digest").distinct()
    have = variants.select("archive_id", "url", "digest").distinct().withColumn("_have", F.lit(True))
    return other.join(have, ["archive_id", "url", "digest"], "left").select("archive_id", "url", "digest", F.when(F.col("_have"), "known-variant").otherwise("new-variant").alias("state"))


def replace_pages(old: DataFrame, new: DataFrame, capture: str | None = None) -> DataFrame:
    """Repaired pages (url, partial, html) replace old ones, unless the new one is still partial and there is an old one.

    A URL is one page; where it may have been captured several times, ``capture`` names the column that tells the captures apart.
    """
    keys = ["url", *([capture] if capture else [])]
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, keys, "full_outer")
    take = F.coalesce("_new", F.lit(False)) & (F.col("_old").isNull() | ~F.coalesce("b.partial", F.lit(False)))
    return both.select(*keys, *[F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("partial", "html")])


def needs_write(old_status: Column, old_size: Column, status: Column, size: Column) -> Column:
    """A response replaces a saved one that is missing, failed while it is good, or is empty while it has a body."""
    good = F.coalesce(status, F.lit(200)) < 400
    return old_status.isNull() | ((old_status >= 400) & good) | ((F.coalesce(old_size, F.lit(0)) == 0) & (size > 0) & good)


def drop_resolved(blocked: DataFrame, saved: DataFrame) -> DataFrame:
    """Failures whose URL (archive_id, url) has been saved since are dropped."""
    return blocked.join(saved.select("archive_id", "url").distinct(), ["archive_id", "url"], "left_anti")


def discovered_queue(found: DataFrame, excluded_hosts: DataFrame) -> DataFrame:
    """The rows of ``found`` whose host isn't in ``excluded_hosts`` (host)."""
    host = urls.parts(F.col("url"))["host"]
    out = excluded_hosts.select(F.col("host").alias("_excluded")).distinct()
    return found.join(out, host == F.col("_excluded"), "left_anti")


def external_hosts(found: DataFrame, start_host: str) -> DataFrame:
    """(host): hosts that are neither the start host nor below it, sorted."""
    host = urls.parts(F.col("url"))["host"]
    return found.select(host.alias("host")).filter(F.col("host").isNotNull() & (F.col("host") != start_host) & ~F.col("host").endswith("." + start_host)).distinct().orderBy("host")


def deferred_summary(deferred: DataFrame) -> DataFrame:
    """(archive_id, items, remaining): deferred media (archive_id, kind, remaining_urls)."""
    n = F.when(F.col("remaining_urls").isNotNull(), F.size("remaining_urls")).when(F.col("kind") == "file", 1).otherwise(0)
    return deferred.groupBy("archive_id").agg(F.count("*").alias("items"), F.sum(n).alias("remaining"))


def complete_deferred(deferred: DataFrame, done: DataFrame) -> DataFrame:
    """Deferred media without finished entries, and whether the archive still has pruned ones."""
    left = deferred.join(done.select("archive_id", "url").distinct(), ["archive_id", "url"], "left_anti")
    return left.groupBy("archive_id").agg(F.count("*").alias("left"), F.coalesce(F.max("pruned"), F.lit(False)).alias("pruned"))


def due_schedules(schedules: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(schedule_id, action): start, or wait ten minutes where the site's job still runs. schedules(schedule_id, archive_id, enabled, next_run_at)."""
    busy = jobs.filter(F.col("status").isin(ACTIVE)).select("archive_id").distinct().withColumn("_busy", F.lit(True))
    rows = schedules.filter(F.col("enabled") & (F.col("next_run_at") <= now)).join(busy, "archive_id", "left")
    return rows.select("schedule_id", F.when(F.col("_busy"), "postpone").otherwise("start").alias("action"))


def alert_times(usage: DataFrame, limit: int, hours: int = 24) -> DataFrame:
    """(ts): checks (ts, used) over the limit that give a notification, at most one in ``hours``.

    Only the first one in each run of checks over the limit and those ``hours`` apart count, so the different times of one service's own checks stream through one task.
    """
    times = usage.filter(F.col("used") > limit).select(F.lit("").alias("kind"), "ts")
    return spaced(times, hours * 3_600_000_000).select("ts")


def references_to(references: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_id, users): live archives that share pages of another. references(source, target)."""
    live = archives.select(F.col("archive_id").alias("source")).distinct()
    return references.filter("source <> target").join(live, "source", "left_semi").groupBy(F.col("target").alias("archive_id")).agg(F.countDistinct("source").alias("users"))


def merge_presets(old: DataFrame, new: DataFrame, limit: int = 50) -> DataFrame:
    """Presets (name, fields, saved_at) by name, the newer one wins; the newest ``limit``."""
    both = old.unionByName(new)
    return both.groupBy("name").agg(F.max_by("fields", "saved_at").alias("fields"), F.max("saved_at").alias("saved_at")).orderBy(F.desc("saved_at"), "name").limit(limit)


def page_options(scope: Column, options: Column, external: Column) -> Column:
    """Capture options of a page: external pages take the overrides."""
    return F.when(scope == "external", F.map_concat(F.map_filter(options, lambda k, v: ~F.map_contains_key(external, k)), external)).otherwise(options)


def limited(value: Column, limit: Column) -> Column:
    return F.when(rules.reached(value, limit), "limit-reached").otherwise("open")

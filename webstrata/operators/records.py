"""Records of jobs, archives, schedules and shared pages: inserts, patches, limits, listings and the shared index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from .jobs import ACTIVE, TERMINAL
from .pages import first_by


def shared_index(pages: DataFrame) -> DataFrame:
    """(url, archive_id, page_url): index of shared pages rebuilt from saved pages (archive_id, saved_at, ordinal, url, requested_url, html).

    Archives are read newest first, so the oldest one's page stays; of an archive's pages the last. Pages without HTML are skipped.
    """
    rows = pages.filter(rules.text(F.col("html")) != "").select("archive_id", "saved_at", "ordinal", F.col("url").alias("page_url"), F.explode(F.array_distinct(F.array_compact(F.array("url", "requested_url")))).alias("url"))
    order = F.struct(F.negative(F.unix_micros(F.col("saved_at").cast("timestamp"))), "archive_id", "ordinal")
    return rows.groupBy("url").agg(F.max_by(F.struct("archive_id", "page_url"), order).alias("p")).select("url", "p.*")


def replayed(log: DataFrame) -> DataFrame:
    """(url, archive_id, page_url): last put of each URL, without archives that were removed after or before it. See ``shared_pages`` for the log."""
    removed = log.filter("remove_archive is not null").groupBy(F.col("remove_archive").alias("archive_id")).agg(F.min("line_no").alias("gone"))
    puts = log.filter("url is not null and archive_id is not null").select("line_no", "url", "archive_id", F.coalesce("page_url", "url").alias("page_url"))
    early = puts.join(removed, "archive_id", "left").filter("gone is null or line_no < gone")
    last = early.groupBy("url").agg(F.max_by(F.struct("archive_id", "page_url"), "line_no").alias("p")).select("url", "p.*")
    return last.join(removed.select("archive_id"), "archive_id", "left_anti").select("url", "archive_id", "page_url")


def compact_log(log: DataFrame, path: str) -> DataFrame:
    """Write the state of a change log as a new log of puts alone and read it back as one."""
    replayed(log).write.mode("overwrite").json(path)
    back = log.sparkSession.read.schema("url string, archive_id long, page_url string").json(path)
    return back.select(F.monotonically_increasing_id().alias("line_no"), "url", "archive_id", "page_url", F.lit(None).cast("long").alias("remove_archive"))


def shared_links(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """(archive_id, page_url, page_id, title, links): the first page saved or asked for under a URL. asked(archive_id, page_url), pages(archive_id, ordinal, page_id, url, requested_url, title, links)."""
    named = pages.select("archive_id", "ordinal", "page_id", "title", "links", F.explode(F.array_distinct(F.array_compact(F.array("url", "requested_url")))).alias("page_url"))
    found = asked.select("archive_id", "page_url").distinct().join(named, ["archive_id", "page_url"])
    return first_by(found, ["archive_id", "page_url"], F.col("ordinal")).drop("ordinal")


def add_references(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Reference edges (source, target) as a set; an archive doesn't refer to itself, and null ends are no edges."""
    return edges.select("source", "target").unionByName(new.select("source", "target")).filter("source <> target").distinct()


def remove_archives(log: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The change log with a removal behind all its lines for each of ``gone`` (archive_id), and the edges that touch none of them."""
    last = log.agg(F.coalesce(F.max("line_no"), F.lit(0)).alias("last"))  # one row
    lines = gone.select("archive_id").distinct().crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.monotonically_increasing_id()).alias("line_no"), F.col("archive_id").alias("remove_archive"))
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("archive_id").alias(end)).distinct(), end, "left_anti")
    return log.unionByName(lines, allowMissingColumns=True), edges.select("source", "target")


def with_ids(rows: DataFrame, prefix: str, name: str = "id") -> DataFrame:
    """Rows with a random id of their own. It differs from run to run, so write it before anything else reads it."""
    return rows.withColumn(name, F.concat(F.lit(prefix + "_"), F.replace(F.uuid(), F.lit("-"))))


def add_jobs(requests: DataFrame, now: Column, kind: str | None = None) -> DataFrame:
    """New jobs with their defaults from (archive_id, start_url, discovery_mode); with ``kind`` (retry, repair) capture begins at once."""
    first = F.array(F.struct(F.col("start_url").alias("url"), F.lit(0).alias("depth"), F.lit("origin").alias("scope"), F.lit(0).alias("external_depth")))
    phase = F.lit("capturing") if kind else F.when(F.col("discovery_mode") == "immediate", "capturing").otherwise("discovering")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("pages", "resources", "bytes", "errors", "depth", "discovered_pages")]
    return requests.select("archive_id", "start_url", F.lit(kind).cast("string").alias("kind"), F.lit("queued").alias("status"), now.alias("created_at"), now.alias("updated_at"), *zeros, F.lit(None).cast("string").alias("warning"), first.alias("queue"), phase.alias("phase"))


def patch_jobs(jobs: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Jobs with the patch of their job_id: its columns that aren't null replace theirs, and updated_at is ``now``. Unknown ids change nothing."""
    fields = [c for c in patches.columns if c != "job_id"]
    hit = patches.select("job_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    rows = jobs.join(hit, "job_id", "left")
    pick = {c: F.coalesce(f"_{c}", c) for c in fields} | {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}
    return rows.select(*[pick.get(c, F.col(c)).alias(c) for c in jobs.columns])


def resume_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs after some of them are resumed: they wait again, a complete one goes back to discovery if pages are planned, else to capture. jobs(job_id, status, phase, planned)."""
    hit = ids.select("job_id").distinct().withColumn("_hit", F.lit(True))
    on = F.coalesce("_hit", F.lit(False))
    again = F.when(F.col("planned") > 0, "discovering").otherwise("capturing")
    rows = jobs.join(hit, "job_id", "left")
    return rows.select(*[{"status": F.when(on, "queued").otherwise(F.col("status")), "phase": F.when(on & (F.col("phase") == "complete"), again).otherwise(F.col("phase"))}.get(c, F.col(c)).alias(c) for c in jobs.columns])


def continue_archives(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """(archive_id, outcome, job_id): the newest job of each archive (archive_id) is resumed, or why it isn't: NOT_FOUND, ARCHIVE_BUSY, NOTHING_TO_CONTINUE.

    jobs(job_id, archive_id, status, created_at, waiting).
    """
    busy = F.coalesce(F.max(F.col("status").isin([*ACTIVE, "paused", "warning"])), F.lit(False))
    of = jobs.groupBy("archive_id").agg(F.max_by(F.struct("job_id", "waiting"), F.struct("created_at", "job_id")).alias("last"), busy.alias("busy"))
    rows = asked.select("archive_id").distinct().join(of, "archive_id", "left")
    outcome = F.when(F.col("last").isNull(), "NOT_FOUND").when(F.col("busy"), "ARCHIVE_BUSY").when(F.coalesce("last.waiting", F.lit(0)) == 0, "NOTHING_TO_CONTINUE").otherwise("resumed")
    return rows.select("archive_id", outcome.alias("outcome"), F.when(outcome == "resumed", F.col("last.job_id")).alias("job_id"))


def upsert_records(old: DataFrame, new: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Records of a service (watches, schedules, batches): known keys are replaced, new ones come in by ``order`` until there are ``limit``."""
    known = old.select(key)
    free = max(0, limit - old.count())
    added = new.join(known, key, "left_anti").orderBy(order, key).limit(free)
    changed = new.join(known, key, "left_semi")
    return old.join(changed.select(key), key, "left_anti").unionByName(changed).unionByName(added)


def publication(jobs: DataFrame, pages: DataFrame, resources: DataFrame, blocked: DataFrame) -> DataFrame:
    """(archive_id, status, pages, resources, bytes, errors) of archives whose capture still runs or is paused; those without a page aren't shown."""
    state = F.when(F.col("status").isin("paused", "warning"), "paused").when(F.col("status").isin(ACTIVE), "running")
    open_ = jobs.select("archive_id", state.alias("status")).filter("status is not null")
    count = lambda df, name: df.groupBy("archive_id").agg(F.count("*").alias(name))
    sizes = resources.groupBy("archive_id").agg(F.count("*").alias("resources"), F.sum("size").alias("bytes"))
    rows = open_.join(count(pages, "pages"), "archive_id").join(sizes, "archive_id", "left").join(count(blocked, "errors"), "archive_id", "left")
    return rows.select("archive_id", "status", "pages", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("resources", "bytes", "errors")])


def normalized_schedule(frequency: Column, hour: Column, minute: Column, weekday: Column, enabled: Column) -> Column:
    """struct of a schedule's fields in their ranges; null for an unknown frequency. Numbers are cut to integers, missing ones take their default."""

    def whole(value: Column, top: int, default: int) -> Column:
        number = value.cast("double")
        return F.when(number.isNull() | F.isnan(number), default).otherwise(F.least(F.lit(top), F.greatest(F.lit(0), number.cast("int"))))

    fields = F.struct(frequency.alias("frequency"), whole(hour, 23, 3).alias("hour"), whole(minute, 59, 0).alias("minute"), whole(weekday, 6, 0).alias("weekday"), F.coalesce(enabled, F.lit(True)).alias("enabled"))
    return F.when(frequency.isin("hourly", "daily", "weekly"), fields)


def cleanup_settings(enabled: Column, limit_gb: Column, include_warc: Column, old_enabled: Column, old_limit: Column, old_warc: Column) -> Column:
    """struct<enabled, limit_gb, include_warc>: given values before current ones, 100 GB before any; null for a limit outside 1 to 100,000 GB."""
    limit = F.coalesce(limit_gb, old_limit, F.lit(100.0))
    flag = lambda given, old: F.coalesce(given, old, F.lit(False))
    return F.when(limit.between(1, 100_000), F.struct(flag(enabled, old_enabled).alias("enabled"), (F.floor(limit * 10 + 0.5) / 10).alias("limit_gb"), flag(include_warc, old_warc).alias("include_warc")))


def summary_pages(pages: DataFrame) -> DataFrame:
    """The columns of pages that a summary of their archive shows; texts, links and bodies stay out."""
    kept = ["archive_id", "ordinal", "url", "requested_url", "title", "depth", "scope", "classification", "level", "score"]
    return pages.select(*[c for c in kept if c in pages.columns])


def ranked_storage(summary: DataFrame) -> DataFrame:
    """Categories of a storage summary that hold something, with their place by size in each archive."""
    place = F.row_number().over(W.partitionBy("archive_id").orderBy(F.desc("bytes"), "category"))
    return summary.filter("bytes > 0").withColumn("place", place)


def export_order(files: DataFrame) -> DataFrame:
    """Files (archive_id, name) with their place in an export: the manifest, then others, blobs last; by name."""
    rank = F.when(F.col("name") == "manifest.json", 0).when(F.col("name").startswith("blobs/"), 2).otherwise(1)
    return files.withColumn("place", F.row_number().over(W.partitionBy("archive_id").orderBy(rank, "name")))


def package_records(pages: DataFrame, resources: DataFrame, aliases: DataFrame) -> DataFrame:
    """The responses that a package of each archive holds: archive_id, url, captured_at, status, headers, mime_type, body.

    pages: archive_id, ordinal, url, requested_url, captured_at, html. resources: archive_id, ordinal, url, captured_at, status, headers, mime_type, body; the first of an
    archive's rows for a URL counts. aliases: archive_id, alias, target. Pages with HTML are responses of their own, with a redirect from another requested URL;
    resources are added unless a page has their URL, and aliases of saved resources are redirects unless a resource has their URL.
    """
    columns = ["archive_id", "url", "captured_at", "status", "headers", "mime_type", "body"]

    def redirect(rows: DataFrame, url: str, target: str) -> DataFrame:
        made = rows.select("archive_id", F.col(url).alias("url"), "captured_at", F.lit(302).alias("status"), F.create_map(F.lit("Location"), F.col(target)).alias("headers"))
        return made.withColumn("mime_type", F.lit("text/html")).withColumn("body", F.lit(b"")).select(*columns)

    shown = pages.filter(rules.text(F.col("html")) != "")
    html = shown.select("archive_id", "url", "captured_at", F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.lit("text/html").alias("mime_type"), F.col("html").cast("binary").alias("body"))
    asked = redirect(shown.filter("requested_url is not null and requested_url <> url"), "requested_url", "url")
    first = first_by(resources, ["archive_id", "url"], "ordinal")
    kept = first.join(pages.select("archive_id", "url").distinct(), ["archive_id", "url"], "left_anti")
    kept = kept.select("archive_id", "url", "captured_at", F.coalesce(F.nullif("status", F.lit(0)), F.lit(200)).alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "mime_type", "body")
    named = aliases.dropDuplicates(["archive_id", "alias", "target"]).join(first.select("archive_id", F.col("url").alias("target"), "captured_at"), ["archive_id", "target"])
    named = named.join(first.select("archive_id", F.col("url").alias("alias")), ["archive_id", "alias"], "left_anti")
    return html.unionByName(asked).unionByName(kept.select(*columns)).unionByName(redirect(named, "alias", "target"))


def issue_pages(audit: DataFrame, limit: int = 30) -> DataFrame:
    """The first ``limit`` pages of each audit (audit_id, ordinal, status, ...) that aren't healthy."""
    place = F.row_number().over(W.partitionBy("audit_id").orderBy("ordinal"))
    return audit.filter("status is null or status <> 'healthy'").withColumn("place", place).filter(F.col("place") <= limit)


def capped(items: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The newest items (kind, at, id) of each kind up to its cap; kinds without a cap stay whole."""
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("at"), F.desc("id")))
    out = F.lit(True)
    for kind, n in caps.items():
        out = F.when(F.col("kind") == kind, F.col("_n") <= n).otherwise(out)
    return items.withColumn("_n", place).filter(out).drop("_n")


def retry_summary(plan: DataFrame, sites: DataFrame, missing: DataFrame) -> DataFrame:
    """(archive_id, failed_pages, login_sites, samples, missing_resources) of a retry plan, its login sites and (archive_id, missing)."""
    failed = plan.groupBy("archive_id").agg(F.count_if(F.col("kind") == "failed").alias("failed_pages"))
    walls = sites.groupBy("archive_id").agg(F.count("*").alias("login_sites"), F.sum(F.size("sample")).alias("samples"))
    rows = failed.join(walls, "archive_id", "full_outer").join(missing.select("archive_id", F.col("missing").alias("missing_resources")), "archive_id", "full_outer")
    return rows.select("archive_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("failed_pages", "login_sites", "samples", "missing_resources")])


def related_logs(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Log rows (event_id, job_id, archive_id) of each job: those that name the job, and those that name its archive."""
    by_job = logs.join(jobs.select("job_id"), "job_id").select("event_id", "job_id")
    by_archive = logs.drop("job_id").join(jobs.select("job_id", "archive_id"), "archive_id").select("event_id", "job_id")
    return by_job.unionByName(by_archive).distinct()


def compact_queues(jobs: DataFrame, path: str) -> DataFrame:
    """Move the queues of ended jobs (job_id, status, queue) to gzip files at ``path``; returns the jobs with short rows."""
    ended = F.col("status").isin(TERMINAL)
    jobs.filter(ended).select("job_id", "queue").write.mode("overwrite").option("compression", "gzip").json(path)
    return jobs.withColumn("queue", F.when(~ended, F.col("queue"))).withColumn("stored", ended)


def restored_queues(jobs: DataFrame, path: str) -> DataFrame:
    """The jobs of ``compact_queues`` with their queues again."""
    kind = dict(jobs.dtypes)
    kept = jobs.sparkSession.read.schema(f"job_id {kind['job_id']}, queue {kind['queue']}").json(path).withColumnRenamed("queue", "_queue")
    return jobs.join(kept, "job_id", "left").withColumn("queue", F.coalesce("queue", "_queue")).drop("_queue", "stored")

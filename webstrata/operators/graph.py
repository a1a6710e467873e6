"""Crawl graph: breadth-first expansion with depths, redirect chains and transitive references, as joins in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import all_rounds, put, shared_dir
from ..sources.shared import cut as _cut


def crawl_frontier(seeds: DataFrame, links: DataFrame, max_depth: int | None = None, max_external: int | None = None, keywords: list[str] | None = None) -> DataFrame:
    """(url, depth, external_depth, scope, parent): what breadth-first search from (url) seeds along (src, dst) links opens within the limits.

    A page found again at a greater depth but with a smaller external depth than before is opened again, since more of what it links to then fits the limit on external depth.
    depth and external_depth are the smallest of all ways to a page, scope and parent those of the first way (smallest depth, then external depth, then parent). Null limits are none; rounds
    go on until nothing new is found. Cycles end because a page is only opened again with a smaller external depth. Each round writes its own pages only, and a URL's
    scope is read once a round.
    """
    words = F.array(*[F.lit(k) for k in keywords]) if keywords else None
    start = seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(0).alias("external_depth"), F.lit("origin").alias("scope"), F.lit(None).cast("string").alias("parent"), F.col("url").alias("root"))
    folder = shared_dir(seeds.sparkSession)
    opened = frontier = put(start, folder, 0)
    depth = 0
    while max_depth is None or depth < max_depth:
        step = frontier.select(F.col("url").alias("src"), "external_depth", "scope", "root").join(links, "src")
        # the external depth of an outside page; an inside one has none, which is known once its URL is read
        carried = urls.next_external_depth(F.lit("external"), F.col("scope"), F.col("external_depth"))
        best = step.groupBy(F.col("dst").alias("url"), "root").agg(F.min(F.struct(carried.alias("outside"), "src")).alias("b"))
        before = opened.groupBy("url", "root").agg(F.min("external_depth").alias("least"))
        best = best.join(before, ["url", "root"], "left").filter("least is null or b.outside < least")
        best = best.withColumn("scope", urls.classify_scope(F.col("root"), F.col("url"), words))
        outside = urls.next_external_depth(F.col("scope"), F.lit("external"), F.col("b.outside") - 1)
        fresh = best.withColumn("external_depth", F.when(F.col("scope") == "external", F.col("b.outside")).otherwise(outside)).filter("least is null or external_depth < least")
        if max_external is not None:
            fresh = fresh.filter(F.col("external_depth") <= max_external)
        depth += 1
        frontier = put(fresh.select("url", F.lit(depth).alias("depth"), F.col("external_depth").cast("int").alias("external_depth"), "scope", F.col("b.src").alias("parent"), "root"), folder, depth)
        if frontier.limit(1).count() == 0:
            break
        opened = all_rounds(frontier, folder)
    first = F.min(F.struct("depth", "external_depth", "parent", "scope")).alias("f")
    return opened.groupBy("url").agg(first, F.min("external_depth").alias("external_depth")).select("url", "f.depth", "external_depth", "f.scope", "f.parent")


def redirect_chains(edges: DataFrame, limit: int = 50) -> DataFrame:
    """(url, final, hops, state): where each redirect (src, dst) ends; loop or too-long where it doesn't.

    Pointers double their reach each round, so a chain of n hops takes log(n) rounds. While some chain hasn't ended, each round ends at least one more of them, or all that are left turn in loops.
    """
    once = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    turning = once.select(F.col("src").alias("final"), F.lit(True).alias("_goes_on"))
    reach = _cut(once.select("src", F.col("dst").alias("final"), F.lit(1).cast("long").alias("hops")))
    going = None
    while True:
        left = reach.join(turning, "final", "left_semi").count()
        if left == going or not left:
            break
        going = left
        ahead = reach.select(F.col("src").alias("final"), F.col("final").alias("next"), F.col("hops").alias("more"))
        jumped = reach.join(ahead, "final", "left")
        reach = _cut(jumped.select("src", F.coalesce("next", "final").alias("final"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    state = F.when(F.coalesce("_goes_on", F.lit(False)), "loop").when(F.col("hops") > limit, "too-long").otherwise("ok")
    return reach.join(turning, "final", "left").select(F.col("src").alias("url"), F.when(state == "ok", F.col("final")).alias("final"), F.when(state == "ok", F.col("hops")).alias("hops"), state.alias("state"))


def reference_closure(roots: DataFrame, edges: DataFrame, rounds: int = 6) -> DataFrame:
    """(url, level): what (url) roots need along (src, dst) references, to ``rounds`` levels; styles that import each other are nested no deeper in practice."""
    folder = shared_dir(roots.sparkSession)
    visited = frontier = put(roots.select("url").distinct().withColumn("level", F.lit(0)), folder, 0)
    for level in range(1, rounds + 1):
        step = frontier.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct()
        frontier = put(step.join(visited.select("url"), "url", "left_anti").withColumn("level", F.lit(level)), folder, level)
        if frontier.limit(1).count() == 0:
            break
        visited = all_rounds(frontier, folder)
    return visited


def discovery_hosts(pages: DataFrame, limit: int = 300) -> DataFrame:
    """(host, n): the ``limit`` hosts with most discovered URLs."""
    return pages.groupBy(urls.parts(F.col("url"))["host"].alias("host")).agg(F.count("*").alias("n")).filter("host is not null").orderBy(F.desc("n"), "host").limit(limit)


def queue_candidates(found: DataFrame, visited: DataFrame, planned: DataFrame) -> DataFrame:
    """Found (url, depth) that are neither visited nor planned, not even under their stable key; the smallest depth of each."""
    key = urls.stable_document_key(F.col("url"))
    known = visited.select(key.alias("key")).unionByName(planned.select(key.alias("key"))).distinct()
    rows = found.withColumn("key", key).join(known, "key", "left_anti")
    return rows.groupBy("key").agg(F.min_by("url", F.struct("depth", "url")).alias("url"), F.min("depth").alias("depth")).drop("key")


def robots_rules(files: DataFrame, agent: str = "webstrata") -> DataFrame:
    """(origin, prefix): Disallow prefixes for all agents or this one, from robots files (origin, content)."""
    from pyspark.sql import Window as W

    lines = files.select("origin", F.posexplode(F.split("content", r"\r?\n")).alias("n", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*", ""))
    rows = lines.select("origin", "n", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"))
    agents = F.when(F.col("name") == "user-agent", (F.col("value") == "*") | (F.lower("value") == agent))
    active = F.last(agents, ignorenulls=True).over(W.partitionBy("origin").orderBy("n"))
    return rows.withColumn("active", active).filter("active and name = 'disallow' and value <> ''").select("origin", F.col("value").alias("prefix")).distinct()


def robots_allowed(pages: DataFrame, rules_: DataFrame) -> DataFrame:
    """Rows of ``pages`` (url) that no prefix of their origin forbids."""
    p = pages.withColumn("_o", urls.parts(F.col("url"))["origin"]).withColumn("_p", urls.parts(F.col("url"))["path"])
    return p.join(rules_, (F.col("_o") == F.col("origin")) & F.col("_p").startswith(F.col("prefix")), "left_anti").drop("_o", "_p")

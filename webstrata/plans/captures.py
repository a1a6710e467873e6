"""Queries of captured pages, media and replay, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import archives as A
from ..operators import capture as M
from ..operators import pages as P
from .queries import HOST, LINES, T
from .reports import CLASS, classified
from .views import cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# scope and references


SITE = "site AS (SELECT DISTINCT archive_id, url FROM captures WHERE scope <> 'external' UNION SELECT archive_id, requested_url FROM captures WHERE scope <> 'external' AND requested_url IS NOT NULL)"


@query("PRD8_start_site", cte("captures") + f", {SITE} SELECT c.page_id, (c.archive_id, c.url) IN (SELECT (archive_id, url) FROM site) OR {HOST.format('c.url')} = 'example.com' OR {HOST.format('c.url')} LIKE '%.example.com' AS in_site FROM captures c")
def _(s, d):
    c = view(s, d, "captures")
    starts = c.select("archive_id", F.lit("https://www.example.com/").alias("start_url")).distinct()
    return M.in_start_site(c.select("archive_id", "page_id", "url"), starts, M.site_urls(c)).select("page_id", "in_site")


@query("JN2_effective_missing", cte("resources") + """, site AS (SELECT DISTINCT archive_id, url FROM resources WHERE ordinal % 2 = 0), lost AS (SELECT DISTINCT archive_id, url FROM resources r WHERE NOT EXISTS (SELECT 1 FROM resources k WHERE k.archive_id = r.archive_id AND k.status = 200 AND k.url = r.url))
SELECT archive_id, count(*) FILTER ((archive_id, url) IN (SELECT (archive_id, url) FROM site) OR url LIKE 'https://cdn3.example/%') AS missing FROM lost GROUP BY archive_id""")
def _(s, d):
    res = view(s, d, "resources")
    audit = P.reference_audit(res.select("archive_id", F.col("url").alias("ref")), res.filter("status = 200").select("archive_id", "url"), s.createDataFrame([], "archive_id long, alias string, target string"))
    starts = res.select("archive_id", F.lit("https://cdn3.example/").alias("start_url")).distinct()
    return M.effective_missing(audit, starts, res.filter("ordinal % 2 = 0").select("archive_id", "url"))


@query("SET1_reference_sources", "SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') || '/i/' || page_id || '.png' AS ref FROM pages UNION SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') || '/s' || (page_id % 3) || '.css' FROM pages UNION SELECT page_id, 'https://c.example/bg' || (page_id % 5) || '.png' FROM pages")
def _(s, d):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<img src="/i/'), k, F.lit('.png"><img data-src="/i/'), k, F.lit('.png#x"><link rel="stylesheet" href="/s'), (F.col("page_id") % 3).cast("string"), F.lit(".css\"><p style=\"background:url('https://c.example/bg"), (F.col("page_id") % 5).cast("string"), F.lit(".png')\">"))
    p = T(s, d, "pages").select("page_id", "url", html.alias("html"))
    return P.asset_references(p.filter("page_id % 2 = 0")).unionByName(P.asset_references(p)).distinct()


@query("SET4_first_reason", cte("captures", "blocked") + f""", c AS (SELECT *, {CLASS} AS k, coalesce(requested_url, url) AS asked FROM captures), f AS (SELECT archive_id, asked AS url, CASE WHEN k IN ('error-page', 'missing-html') THEN 'error page' ELSE 'partial' END AS reason, 1 AS source, ordinal FROM c WHERE k IN ('error-page', 'missing-html') OR partial
 UNION ALL SELECT archive_id, asked, 'again', 2, 0 FROM c WHERE page_id % 2 = 0)
SELECT archive_id, url, arg_min(reason, struct_pack(s := source, o := ordinal)) AS reason FROM f WHERE (archive_id, url) NOT IN (SELECT (archive_id, url) FROM c WHERE k = 'normal' AND NOT partial) AND (archive_id, url) NOT IN (SELECT (archive_id, requested_url) FROM c WHERE k = 'normal' AND NOT partial AND requested_url IS NOT NULL)
 AND (archive_id, url) NOT IN (SELECT (archive_id, asked) FROM c WHERE k = 'login-required') GROUP BY archive_id, url""")
def _(s, d):
    c = classified(s, d)
    again = c.filter("page_id % 2 = 0").select("archive_id", F.coalesce("requested_url", "url").alias("url"), F.lit("failed").alias("status"), F.lit("again").alias("reason"))
    return A.retry_plan(c, again, view(s, d, "blocked").filter("false")).filter("kind = 'failed'").select("archive_id", "url", "reason")


@query("AGG5_background_images", "SELECT page_id % 40 AS archive_id, 'https://c.example/' || kind || (page_id % 20) || '.png' AS url FROM pages, (VALUES ('a'), ('b'), ('c')) t(kind) UNION SELECT page_id % 40, 'https://t.example/' || (page_id % 20) FROM pages WHERE page_id % 20 < 10")
def _(s, d):
    n = (F.col("page_id") % 20).cast("string")
    p = T(s, d, "pages").select((F.col("page_id") % 40).alias("archive_id"), "page_id", "url", n.alias("n"))
    styles = p.select("archive_id", F.lit("https://c.example/x/m.css").alias("url"), F.concat(F.lit("p{background:url(../a"), "n", F.lit(".png)}")).alias("css"))
    html = F.concat(F.lit("<style>q{background: url('https://c.example/b"), "n", F.lit(".png')}</style><p style=\"background:url(&quot;https://c.example/c"), "n", F.lit('.png&quot;)"><img src="https://c.example/not.png">'))
    aliases = p.filter("page_id % 20 < 10").select("archive_id", F.concat(F.lit("https://c.example/a"), "n", F.lit(".png")).alias("alias"), F.concat(F.lit("https://t.example/"), "n").alias("target")).distinct()
    other = p.select("archive_id", F.lit("https://c.example/none.png").alias("alias"), F.lit("https://t.example/none").alias("target")).distinct()
    return M.background_images(styles, p.select("archive_id", "url", html.alias("html")), aliases.union(other))


# graph and differences


@query("GRF2_discovery", cte("links").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", e AS (SELECT DISTINCT src, dst FROM links), walk AS (SELECT 'https://g0.example/1' AS url, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url WHERE w.depth < 3), p AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
SELECT {HOST.format('url')} AS host, count(*) AS pages, min(depth) AS depth FROM p GROUP BY host""")
def _(s, d):
    return M.discover(s.createDataFrame([("https://g0.example/1",)], "url string"), view(s, d, "links").distinct(), 3)


@query("GRF4_WIN5_redirect_depth", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = user_id % 3 THEN greatest(1, user_id % 4) WHEN user_id % 3 > 0 THEN greatest(1, user_id % 4) + 1 ELSE 1 END AS depth, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = user_id % 3 THEN greatest(1, user_id % 4) WHEN user_id % 3 > 0 THEN greatest(1, user_id % 4) + 1 ELSE 1 END AS chain FROM events")
def _(s, d):
    site = lambda n: F.element_at(F.array(*[F.lit(u) for u in ("https://a.example.com/x", "https://b.other.net/y", "https://c.third.co.jp/z")]), (n + 1).cast("int"))
    e = T(s, d, "events").select("event_id", site(F.col("user_id") % 3).alias("source"), site(F.col("event_id") % 3).alias("target"), (F.col("user_id") % 4).alias("d"))
    # the sites are worked out once a row, for both depths: a generated column isn't put into what is made from it
    sites = F.explode(F.array(F.struct(urls.site_of(F.lit("https://www.example.com/")).alias("start"), urls.site_of(F.col("source")).alias("source"), urls.site_of(F.col("target")).alias("target"))))
    e = e.select("event_id", "d", sites.alias("at")).select("event_id", "d", "at.*")
    at = (F.col("start"), F.col("source"), F.col("d"), F.col("target"))
    return e.select("event_id", urls.external_depth_between(*at).alias("depth"), urls.chain_depth_between(*at).alias("chain"))


@query("GRF7_prefetch", """
WITH u AS (SELECT page_id, 'https://www.site' || (page_id % 9) || '.example/' AS base FROM pages)
SELECT page_id, base || 'pre' || page_id || '.js' AS url, 1 AS place FROM u UNION ALL SELECT page_id, base || 'a.js', 2 FROM u UNION ALL SELECT page_id, base || 'lib/m' || page_id || '.mjs', CASE WHEN page_id % 2 = 0 THEN 3 ELSE 3 END FROM u UNION ALL SELECT page_id, 'https://cdn.other.example/b.js', 4 FROM u WHERE page_id % 2 = 0""")
def _(s, d):
    k = F.col("page_id").cast("string")
    base = F.concat(F.lit("https://www.site"), (F.col("page_id") % 9).cast("string"), F.lit(".example/"))
    head = F.concat(F.lit('<link rel="preload" as="script" href="pre'), k, F.lit('.js"><link rel=preload as=image href=i.png><link rel="modulepreload" href="https://elsewhere.example/x.js">'))
    body = F.concat(F.lit("<script>load('./a.js'); load('https://www.google-analytics.com/ga.js'); load('/known.js'); import(\"/lib/m"), k, F.lit(".mjs\")</script>"))
    p = T(s, d, "pages").select("page_id", base.alias("url"), F.concat(head, body).alias("html"))
    scripts = p.filter("page_id % 2 = 0").select("page_id", F.lit("https://cdn.other.example/a/x.js").alias("url"), F.lit("use('../b.js'); use('https://third.example/c.js'); use('https://cdn.other.example/b.js')").alias("body"))
    known = p.select("page_id", F.concat("url", F.lit("known.js")).alias("url"))
    return M.prefetch_candidates(p, scripts, known)


@query("JN3_GRF9_ORD5_line_changes", "WITH c AS (SELECT page_id, page_id % 4 AS added, page_id % 3 AS removed FROM pages WHERE page_id % 12 > 0) SELECT page_id, CAST(added AS INTEGER) AS added, CAST(removed AS INTEGER) AS removed FROM c")
def _(s, d):
    p = T(s, d, "pages").select(F.lit(1).alias("archive_id"), F.col("page_id").alias("ordinal"), "page_id", F.concat(F.lit("https://d.example/"), F.col("page_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("requested_url"), F.lit("t").alias("title"), "html")
    k = F.col("page_id")
    more = p.withColumn("html", F.concat(F.repeat(F.lit("<p>new line one</p>"), (k % 4).cast("int")), "html"))
    less = p.withColumn("html", F.concat("html", F.repeat(F.lit("<p>old line two</p>"), (k % 3).cast("int"))))
    return P.line_changes(P.archive_diff(more, less)).select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "added", "removed")


@query("GRF10_page_diff", f"WITH p AS (SELECT page_id, {LINES} AS l FROM pages WHERE page_id % 10 = 7), n AS (SELECT min(page_id) AS k FROM p), l AS (SELECT l, len(l) AS m FROM p JOIN n ON page_id = k) SELECT 'compared' AS status, 0 AS place, 'remove' AS op, 'gone' AS line UNION ALL SELECT 'compared', CAST(unnest(range(m)) AS INTEGER) + 1, 'same', unnest(l) FROM l UNION ALL SELECT 'compared', CAST(m AS INTEGER) + 1, 'add', 'more & more' FROM l")
def _(s, d):
    c = T(s, d, "pages").select(F.lit(1).alias("archive_id"), F.col("page_id").alias("ordinal"), "page_id", "url", F.lit(None).cast("string").alias("requested_url"), F.lit("t").alias("title"), "html")
    asked = c.filter("page_id % 10 = 7").orderBy("page_id").limit(1).select("url").first()[0]
    now, old = c.withColumn("html", F.concat("html", F.lit("<p>more &amp; more</p>"))), c.withColumn("html", F.concat(F.lit("<p>gone</p>"), "html"))
    return M.page_diff(now, old, F.lit(asked)).select("status", "place", "op", "line")


@query("WIN2_first_wins", cte("captures") + "SELECT archive_id, title, min(page_id) AS page_id FROM captures GROUP BY ALL")
def _(s, d):
    return P.first_by(view(s, d, "captures"), ["archive_id", "title"], F.col("ordinal")).select("archive_id", "title", "page_id")


# requests


@query("JN16_page_identity", cte("posts") + """, r AS (SELECT archive_id, url, id, 'abcdef' || (id % 11) AS v, 'zzzzzz' || (id % 3) AS w FROM posts WHERE id % 3 = 0),
q AS (SELECT archive_id, url, id, 'https://p.example/watch?v=abcdef' || (id % 13) || CASE WHEN id % 2 = 0 THEN '&w=zzzzzz' || (id % 5) ELSE '' END AS page FROM posts WHERE id % 3 = 1),
s AS (SELECT q.id, r.id AS response, CASE WHEN contains(page, v) THEN 1 ELSE 0 END + CASE WHEN contains(page, w) THEN 1 ELSE 0 END AS score FROM q JOIN r ON q.archive_id = r.archive_id AND q.url = r.url)
SELECT id, arg_min(response, struct_pack(a := -score, b := 2 - score, c := response)) AS response, max(score) AS score FROM s WHERE score > 0 GROUP BY id""")
def _(s, d):
    p = view(s, d, "posts")
    page = F.concat(F.lit("https://p.example/watch?v=abcdef"), (F.col("id") % 13).cast("string"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("&w=zzzzzz"), (F.col("id") % 5).cast("string"))).otherwise(""))
    saved = p.filter("id % 3 = 0").withColumn("response", F.col("id"))
    leaf = lambda path, v: saved.select("response", F.lit(path).alias("path"), v.alias("value"))
    leaves = leaf("videoId", F.concat(F.lit("abcdef"), (F.col("id") % 11).cast("string"))).union(leaf("a.query", F.concat(F.lit("zzzzzz"), (F.col("id") % 3).cast("string")))).union(leaf("id", F.lit("abc"))).union(leaf("title", F.lit("abcdef")))
    return M.page_identity_posts(p.filter("id % 3 = 1").withColumn("page_url", page), saved, leaves)


@query("TXT23_graphql_variables", "SELECT event_id AS id, '{\"a\":{\"x\":' || (event_id % 9) || ',\"y\":[2,1]},\"b\":' || user_id || '}' AS vars FROM events")
def _(s, d):
    v = F.concat(F.lit('{ "b" : '), F.col("user_id").cast("string"), F.lit(', "a": {"y": [2, 1], "x": '), (F.col("event_id") % 9).cast("string"), F.lit("}}"))
    return T(s, d, "events").select(F.col("event_id").alias("id"), text.canonical_json(v).alias("vars"))


# media and bodies


@query("MSC7_media_plan", cte("resources") + "SELECT archive_id, ordinal, CASE WHEN size * 3 > 60000 AND l THEN 'deferred-limit' ELSE 'complete' END AS plan FROM (SELECT *, status = 200 AND ordinal % 2 = 0 AS l FROM resources) WHERE mime_type LIKE 'video/%' AND (l OR size = 0)")
def _(s, d):
    res = view(s, d, "resources")
    part = (F.col("status") == 200) & (F.col("ordinal") % 2 == 0)
    rows = res.withColumn("url", F.concat("url", F.lit("&o="), F.col("ordinal").cast("string"))).withColumn("content_range", F.when(part, F.concat(F.lit("bytes 0-9/"), (F.col("size") * 3).cast("string")))).withColumn("declared", F.col("size")).withColumn("kind", F.lit(None).cast("string"))
    return M.media_plan(rows, 60_000, False).select("archive_id", F.regexp_extract("url", r"o=(\d+)", 1).cast("long").alias("ordinal"), "plan")


@query("MSC8_empty_bodies", cte("resources") + "SELECT DISTINCT archive_id, url FROM resources r WHERE size = 0 AND status = 200 AND NOT EXISTS (SELECT 1 FROM resources k WHERE k.archive_id = r.archive_id AND k.url = r.url AND k.size > 0)")
def _(s, d):
    res = view(s, d, "resources")
    return M.empty_bodies(res, res.filter("size > 0"))


@query("MSC8_missing_srcset", "WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS o FROM pages) SELECT page_id, o || '/i/a' || page_id || '.png' AS url FROM u UNION ALL SELECT page_id, o || '/i/c.png?x=1&y=2' FROM u WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'https://c.example/d,e.png' FROM u")
def _(s, d):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<img srcset="/i/a'), k, F.lit(".png 1x, /i/c.png?x=1&amp;y=2 2x, data:image/png;base64,xx 3x\"><source srcset='https://c.example/d,e.png 100w'>"))
    p = T(s, d, "pages").select("page_id", "url", html.alias("html"))
    known = p.filter("page_id % 2 = 1").select("page_id", F.concat(urls.parts(F.col("url"))["origin"], F.lit("/i/c.png?x=1&y=2")).alias("url"))
    return M.missing_srcset(p, known)


@query("MSC3_resolve_asset", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^https?://[^/?#]*') || '/a/b' || page_id || '.png#top' WHEN 1 THEN '#here' WHEN 2 THEN 'https://x.example/q?a=1&b=2' ELSE '/archive/' || page_id || '/x' END AS asset FROM pages")
def _(s, d):
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 4
    value = F.when(n == 0, F.concat(F.lit("/a/./b"), k, F.lit(".png#top"))).when(n == 1, "#here").when(n == 2, "https://x.example/q?a=1&amp;b=2").otherwise(F.concat(F.lit("/archive/"), k, F.lit("/x")))
    return T(s, d, "pages").select("page_id", M.resolve_asset(value, F.col("url"), F.col("page_id")).alias("asset"))


SAVED = "'/archive/' || page_id || '/resource?url=' || replace(url_encode({0}), '%2A', '*')"


@query("TXT26_rewrite_css_script", f"""
SELECT page_id, 'a{{background:url("' || {SAVED.format("'https://c.example/s/i' || page_id || '.png'")} || '")}} b{{background:url(data:x)}} @import "' || {SAVED.format("'https://c.example/b.css'")} || '"; c' AS css,
 'import x from "' || {SAVED.format("'https://c.example/s/m' || page_id || '.js'")} || '"; import(''' || {SAVED.format("'https://c.example/lib.mjs'")} || '''); import y from "react"; z' AS script FROM pages""")
def _(s, d):
    k, base = F.col("page_id").cast("string"), F.lit("https://c.example/s/m.css")
    css = F.concat(F.lit("a{background:url( 'i"), k, F.lit(".png')} b{background:url(data:x)} @import '/b.css'; c"))
    script = F.concat(F.lit('import x from "./m'), k, F.lit(".js\"; import('/lib.mjs'); import y from \"react\"; z"))
    return T(s, d, "pages").select("page_id", M.rewrite_css(css, base, F.col("page_id")).alias("css"), M.rewrite_script(script, base, F.col("page_id")).alias("script"))


@query("TXT26_import_maps", f"""
SELECT page_id, '<script>a</script><script type="importmap">' || CASE WHEN page_id % 5 = 0 THEN '{{broken ' || page_id ELSE '{{"imports":{{"app":"' || {SAVED.format("'https://c.example/s/m' || page_id || '.js'")} || '","lib/":"' || {SAVED.format("'https://c.example/lib/'")} || '","x":null}}'
  || CASE page_id % 3 WHEN 0 THEN ',"scopes":{{"' || {SAVED.format("'https://c.example/p/'")} || '":{{"app":"' || {SAVED.format("'https://d.example/' || page_id")} || '"}}}}' ELSE '' END || '}}' END || '</script>' AS html FROM pages""")
def _(s, d):
    k, base = F.col("page_id").cast("string"), F.lit("https://c.example/s/page")
    scopes = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(',"scopes":{"/q/../p/":{"app":"//d.example/0"},"/p/":{"app":"//d.example/'), k, F.lit('"}}'))).otherwise("")
    good = F.concat(F.lit('{"imports": {"app":"./m'), k, F.lit('.js","lib/":"../lib/","x":null}'), scopes, F.lit("}"))
    html = F.concat(F.lit('<script>a</script><script type="importmap">'), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("{broken "), k)).otherwise(good), F.lit("</script>"))
    return T(s, d, "pages").select("page_id", M.rewrite_import_maps(html, base, F.col("page_id")).alias("html"))


@query("JN18_products_videos", """
SELECT 'p' || page_id AS id, CASE page_id % 3 WHEN 0 THEN '{"handle":"h' || page_id || '","id":' || page_id || ',"variants":[{"id":1}]}' ELSE '{"handle":"h' || page_id || '","variants":[]}' END AS answer FROM pages WHERE page_id % 3 < 2
UNION ALL SELECT 'v' || page_id, '{"videoDetails":{"videoId":"video_' || page_id || '","t":"}"}}' FROM pages WHERE page_id % 4 = 1""")
def _(s, d):
    from ..operators import requests as R

    k, n = F.col("page_id").cast("string"), F.col("page_id")
    archive, shop = (n % 40).alias("archive_id"), F.concat(F.lit("https://shop"), (n % 7).cast("string"), F.lit(".example"))
    script = lambda body: F.concat(F.lit("<script type='application/json'>"), body, F.lit("</script>"))
    product = F.concat(F.lit('{"id":'), k, F.lit(',"handle":"h'), k, F.lit('","variants":[{"id":1}]}'))
    inside = F.concat(F.lit('{"product":{"variants":[],"handle":"h'), k, F.lit('"}}'))
    wrong = F.concat(F.lit('{"handle":"h'), k, F.lit('","variants":3}'))
    html = F.concat(script(F.lit("{broken")), script(F.lit('{"handle":"other","variants":[]}')), script(F.when(n % 3 == 0, product).when(n % 3 == 1, inside).otherwise(wrong)), script(wrong))
    pages = T(s, d, "pages")
    shown = pages.select(archive, n.alias("ordinal"), F.concat(shop, F.lit("/en/products/h"), k, F.lit("/")).alias("url"), html.alias("html"))
    asked = pages.select(F.concat(F.lit("p"), k).alias("id"), archive, F.concat(shop, F.lit("/products/h"), k, F.when(n % 2 == 0, ".js").otherwise(".json"), F.lit("?x=1")).alias("url"))
    video = F.concat(F.lit("<script>var ytInitialPlayerResponse = {\"videoDetails\":{\"videoId\":\"video_"), F.when(n % 4 == 3, "other").otherwise(k), F.lit('","t":"}"}};</script>'))
    at = F.when(n % 8 == 1, F.concat(F.lit("https://www.youtube.com/watch?x=1&v=video_"), k)).when(n % 8 == 2, F.concat(F.lit("https://tube.example/watch?v=video_"), k)).otherwise(F.concat(F.lit("https://youtu.be/video_"), k))
    clips = pages.filter("page_id % 4 > 0").select(archive, n.alias("ordinal"), at.alias("url"), F.when(n % 4 == 2, "").otherwise(video).alias("html"))
    wanted = pages.select(F.concat(F.lit("v"), k).alias("id"), archive, F.concat(F.lit("video_"), k).alias("video_id"))
    return R.product_lookup(asked, shown).select("id", F.col("product").alias("answer")).unionByName(R.video_lookup(wanted, clips).select("id", F.col("player").alias("answer")))


@query("TXT15_stored_text", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'shift_jis' WHEN 1 THEN 'euc-jp' WHEN 2 THEN 'utf-8' ELSE 'windows-1252' END AS charset, CASE page_id % 4 WHEN 3 THEN 'caf' || chr(233) ELSE chr(26085) || chr(26412) END || page_id AS body FROM pages")
def _(s, d):
    n, k = F.col("page_id") % 4, F.col("page_id").cast("string").cast("binary")
    body = F.concat(F.when(n == 0, F.unhex(F.lit("93FA967B"))).when(n == 1, F.unhex(F.lit("C6FCCBDC"))).when(n == 2, F.unhex(F.lit("E697A5E69CAC"))).otherwise(F.unhex(F.lit("636166E9"))), k)
    mime = F.when(n == 0, "text/html; charset=x-sjis").when(n == 2, "text/html; charset=euc-jp").otherwise("text/plain")
    recorded = F.when(n == 1, "EUC-JP").when(n == 3, "latin1")
    rows = T(s, d, "pages").select("page_id", body.alias("body"), M.stored_charset(recorded, mime, body).alias("charset"))
    return rows.select("page_id", "charset", M.decode_text("body", "charset").alias("body"))


@query("MSC1_watch_text", "SELECT doc_id, sha256(t) AS hash, CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 100000) AS t FROM documents)")
def _(s, d):
    t = F.col("text")
    return T(s, d, "documents").select("doc_id", F.sha2(text.watch_text(t), 256).alias("hash"), text.excerpt(t).alias("excerpt"))


# replay


@query("MSC9_substitutes", cte("blocked") + f"SELECT DISTINCT url, CASE WHEN {HOST.format('url')} = 'accounts.google.com' THEN 'document' END AS kind FROM blocked UNION ALL SELECT * FROM (VALUES ('https://p.typekit.net/p.gif', 'gif'), ('https://s.example/cdn/wpm/b.js', 'script'), ('https://shop.app/pay/session/x', 'json'), ('https://shop.app/pay/x.js', 'script'), ('https://h.example/collect', 'document')) t(url, kind)")
def _(s, d):
    more = s.createDataFrame([(u,) for u in ("https://p.typekit.net/p.gif", "https://s.example/cdn/wpm/b.js", "https://shop.app/pay/session/x", "https://shop.app/pay/x.js", "https://h.example/collect")], "url string")
    return view(s, d, "blocked").select("url").distinct().union(more).select("url", M.substitute(F.col("url"), F.lit("")).alias("kind"))


@query("MSC12_visual_comparison", "WITH a AS (SELECT event_id, 'u' || event_id AS url, value / 500 AS similarity FROM events WHERE event_id % 5 > 0), t AS (SELECT * FROM a ORDER BY similarity, url LIMIT 200) SELECT url, similarity, url = (SELECT arg_min(url, event_id) FROM a) AS chosen FROM t")
def _(s, d):
    e = T(s, d, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.when(F.col("event_id") % 5 > 0, F.col("value") / 500).alias("similarity"))
    return M.visual_comparison(e)


@query("MSC13_history", "SELECT event_id, CASE WHEN event_type = 'view' OR event_type = 'click' AND user_id % 4 = 1 THEN ['a', 'b', 'c', 'd'] ELSE list_append((['a', 'b', 'c', 'd'])[1:(user_id % 4) + 1], CASE WHEN event_type = 'click' THEN 'b' ELSE event_type END) END AS history, CASE WHEN event_type = 'view' OR event_type = 'click' AND user_id % 4 = 1 THEN user_id % 4 ELSE user_id % 4 + 1 END AS at FROM events")
def _(s, d):
    url = F.when(F.col("event_type") == "click", "b").when(F.col("event_type") != "view", F.col("event_type"))
    h = M.append_history(F.array(*[F.lit(x) for x in "abcd"]), (F.col("user_id") % 4).cast("int"), url)
    return T(s, d, "events").select("event_id", h["history"].alias("history"), h["index"].cast("long").alias("at"))


@query("EVT9_rendered_counters", "SELECT user_id AS page_id, count(*) AS images, count(*) FILTER (event_id % 4 > 0 AND value >= 50) AS loaded, count(*) FILTER (event_id % 4 > 0 AND value < 50) AS broken, count(*) FILTER (event_id % 4 = 0) AS pending, count(*) FILTER (event_id % 4 > 0 AND value < 50 AND event_type = 'view') AS visible_broken FROM events GROUP BY user_id")
def _(s, d):
    e = T(s, d, "events").select(F.col("user_id").alias("page_id"), (F.col("event_id") % 4 > 0).alias("complete"), F.when(F.col("value") >= 50, 10).alias("natural_width"), (F.col("event_type") == "view").alias("visible"))
    return M.rendered_counters(e)

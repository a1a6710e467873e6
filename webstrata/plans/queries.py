"""Registered queries of the web-archive operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, rules, text, urls
from ..functions.fixed import COUNTRY_SUFFIXES, PRIVATE_SUFFIXES, SUFFIX_EXCEPTIONS, WILDCARD_COUNTRIES
from ..operators import pages as P
from ..operators import requests as R
from ..operators import suffixes
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


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


HOST = "lower(regexp_extract({0}, '^https?://([^/?#]*)', 1))"
PATH = "regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1)"
DOMAIN = "CASE WHEN regexp_matches({0}, '\\.co\\.jp$') THEN array_to_string(list_slice(string_split({0}, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split({0}, '.'), -2, -1), '.') END"


# URL functions

@query("URL1_normalize_url", "SELECT page_id, regexp_replace(url, '#.*$', '') AS href FROM pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("href"))


@query("URL2_registrable_domain", cte("archives") + f"SELECT archive_id, {DOMAIN.format(HOST.format('start_url'))} AS domain FROM archives")
def _(s, d):
    return view(s, d, "archives").select("archive_id", urls.registrable_domain(urls.parts(F.col("start_url"))["host"]).alias("domain"))


ENDS = ["example.com", "example.co.uk", "example.me.uk", "x.org.de", "a.b.ck", "www.ck", "c.www.ck", "user.github.io", "bucket.s3.amazonaws.com", "co.jp", "192.0.2.7", "deep.a.com.au", "city.np", "plain"]


def suffix_hosts(s, d) -> DataFrame:
    """Hosts of all pages below domains of many kinds."""
    end = F.element_at(F.array(*[F.lit(x) for x in ENDS]), (F.col("page_id") % len(ENDS) + 1).cast("int"))
    own = F.when(F.col("page_id") % 3 > 0, F.concat(F.regexp_extract(F.lower("url"), r"^https?://([a-z0-9-]+)", 1), F.lit("."))).otherwise("")
    return T(s, d, "pages").select("page_id", F.when(end.isin("192.0.2.7", "co.jp"), end).otherwise(F.concat(own, end)).alias("host"))


RULES = ", ".join(f"('{r}')" for r in [f"{x}.{c}" for c, xs in COUNTRY_SUFFIXES.items() for x in xs.split()] + [f"*.{c}" for c in WILDCARD_COUNTRIES] + [f"!{h}" for h in SUFFIX_EXCEPTIONS] + PRIVATE_SUFFIXES)


@query("URL2_suffix_join", f"""
WITH p AS (SELECT page_id, ({ENDS})[page_id % {len(ENDS)} + 1] AS e, regexp_extract(lower(url), '^https?://([a-z0-9-]+)', 1) AS own FROM pages),
h AS (SELECT page_id, CASE WHEN page_id % 3 > 0 AND e NOT IN ('192.0.2.7', 'co.jp') THEN own || '.' ELSE '' END || e AS host FROM p),
r AS (SELECT rule, CASE WHEN rule LIKE '!%' THEN substr(rule, 2) WHEN rule LIKE '*.%' THEN substr(rule, 3) ELSE rule END AS bare FROM (VALUES {RULES}) t(rule)),
m AS (SELECT page_id, host, CASE WHEN rule LIKE '!%' THEN 99 WHEN rule LIKE '*.%' THEN len(string_split(bare, '.')) + 1 ELSE len(string_split(bare, '.')) END AS weight, len(string_split(bare, '.')) + CASE WHEN rule LIKE '!%' THEN -1 WHEN rule LIKE '*.%' THEN 1 ELSE 0 END AS size
  FROM h JOIN r ON host = bare AND rule NOT LIKE '*.%' OR host LIKE '%.' || bare),
b AS (SELECT page_id, arg_max(size, weight) AS size FROM m GROUP BY page_id)
SELECT h.page_id, host, CASE WHEN host = '192.0.2.7' OR len(string_split(host, '.')) <= coalesce(size, 1) THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -coalesce(size, 1) - 1, -1), '.') END AS domain FROM h LEFT JOIN b USING (page_id)""")
def _(s, d):
    hosts = suffix_hosts(s, d)
    return hosts.join(suffixes.registrable(hosts, suffixes.own_rules(s)), "host").select("page_id", "host", "domain")


@query("URL3_classify_scope", cte("links") + f""", l AS (SELECT DISTINCT src, dst, (length(dst) + length(src)) % 4 AS k FROM links), u AS (SELECT src, dst, 'https://' || CASE k WHEN 0 THEN 'www.' WHEN 1 THEN 'gamma.' ELSE '' END || regexp_replace({HOST.format('src')}, 'example', 'example.co.uk') || '/' AS a, 'https://' || CASE k WHEN 1 THEN 'docs.gamma.' WHEN 2 THEN 'm.' ELSE '' END || regexp_replace({HOST.format('dst')}, 'example', 'example.co.uk') || '/x' AS b FROM l),
h AS (SELECT src, dst, {HOST.format('a')} AS a, {HOST.format('b')} AS b FROM u), t AS (SELECT *, array_to_string(list_slice(string_split(a, '.'), CASE WHEN a LIKE '%.co.uk' THEN -3 ELSE -2 END, -1), '.') AS da, array_to_string(list_slice(string_split(b, '.'), CASE WHEN b LIKE '%.co.uk' THEN -3 ELSE -2 END, -1), '.') AS db FROM h)
SELECT src, dst, CASE WHEN a = b THEN 'origin' WHEN da = db THEN 'site' WHEN contains(a, 'gamma') AND contains(b, 'gamma') THEN 'keyword-site' ELSE 'external' END AS scope FROM t""")
def _(s, d):
    host = lambda c: F.regexp_replace(urls.parts(F.col(c))["host"], "example", "example.co.uk")
    k = (F.length("dst") + F.length("src")) % 4
    a = F.concat(F.lit("https://"), F.when(k == 0, "www.").when(k == 1, "gamma.").otherwise(""), host("src"), F.lit("/"))
    b = F.concat(F.lit("https://"), F.when(k == 1, "docs.gamma.").when(k == 2, "m.").otherwise(""), host("dst"), F.lit("/x"))
    rows = view(s, d, "links").select("src", "dst").distinct().select("src", "dst", a.alias("a"), b.alias("b"))
    return rows.select("src", "dst", urls.classify_scope(F.col("a"), F.col("b"), F.array(F.lit("gamma"))).alias("scope"))


@query("URL4_keyword_matches_host", cte("archives") + f"SELECT archive_id, regexp_matches({HOST.format('start_url')}, '(^|[.-])docs([.-]|$)') AS matches FROM archives")
def _(s, d):
    return view(s, d, "archives").select("archive_id", urls.keyword_matches_host(urls.parts(F.col("start_url"))["host"], F.lit("docs")).alias("matches"))


@query("URL5_normalize_keywords", cte("archives") + "SELECT archive_id, (list_filter([lower(folder), 'tag' || (archive_id % 7), 'shop'], lambda x: regexp_matches(x, '^[a-z0-9-]{4,32}$') AND x <> 'shop'))[1] AS first FROM (SELECT archive_id, replace(folder, ' ', '-') AS folder FROM archives)")
def _(s, d):
    words = F.concat_ws(",", F.replace("folder", F.lit(" "), F.lit("-")), F.concat(F.lit("tag"), (F.col("archive_id") % 7).cast("string")), F.lit("shop"))
    return view(s, d, "archives").select("archive_id", F.try_element_at(urls.normalize_keywords(words), F.lit(1)).alias("first"))


@query("URL6_stable_document_key", "SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN page_id % 2 = 0 THEN CASE WHEN contains(url, '?') THEN '' ELSE '?a=1' END ELSE CASE WHEN contains(url, '?') THEN '&x=2' ELSE '?x=2' END END AS key FROM pages")
def _(s, d):
    plain = F.regexp_replace("url", "#.*$", "")
    odd = F.concat(plain, F.when(plain.contains("?"), "&").otherwise("?"), F.lit("Nonce=7&x=2&NONCE=8"))
    even = F.when(plain.contains("?"), plain).otherwise(F.concat(plain, F.lit("?a=1")))
    return T(s, d, "pages").select("page_id", urls.stable_document_key(F.when(F.col("page_id") % 2 == 0, even).otherwise(odd)).alias("key"))


@query("URL7_query_policy", "SELECT page_id, regexp_replace(url, '\\?[^#]*', '') AS none, regexp_replace(regexp_replace(url, '[?&](ref|utm_[a-z]+)=[^&#]*', '', 'g'), '^([^?&#]*)&', '\\1?') AS kept FROM pages")
def _(s, d):
    u = F.col("url")
    return T(s, d, "pages").select("page_id", urls.apply_query_policy(u, "drop-all").alias("none"), urls.apply_query_policy(u, "drop-tracking").alias("kept"))


@query("URL8_surt_key", f"""
SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace({HOST.format('url')}, '^www[0-9]*\\.', ''), '.')), ',') || ')' || CASE WHEN {PATH.format('url')} = '' THEN '/' ELSE lower({PATH.format('url')}) END
  || CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_sort(string_split(lower(regexp_extract(url, '\\?([^#]*)', 1)), '&')), '&') ELSE '' END AS surt FROM pages""")
def _(s, d):
    return T(s, d, "pages").select("page_id", urls.surt_key(F.col("url")).alias("surt"))


@query("URL9_timestamp14", "SELECT o_orderkey AS archive_id, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders")
def _(s, d):
    return T(s, d, "orders").select(F.col("o_orderkey").alias("archive_id"), urls.timestamp14(F.col("o_orderdate")).alias("stamp"))


@query("URL10_stable_query", cte("resources") + "SELECT DISTINCT url, '[[\"id\",\"' || regexp_extract(url, 'id=([0-9]+)', 1) || '\"]]' AS stable FROM resources")
def _(s, d):
    return view(s, d, "resources").select("url").distinct().select("url", urls.stable_query(F.col("url")).alias("stable"))


@query("URL11_image_variant_key", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ytimg:abcdef' || user_id WHEN 1 THEN 'ytimg:abcdef' || user_id WHEN 2 THEN 'sized:lh' || (user_id % 7) || '.googleusercontent.com/photograph-' || user_id END AS key FROM events")
def _(s, d):
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    clip = F.concat(F.lit("https://i1.ytimg.com/vi/abcdef"), u, F.lit("/hq720.jpg"))
    webp = F.concat(F.lit("https://i.ytimg.com/an_webp/abcdef"), u, F.lit("/mqdefault.webp?x=1"))
    sized = F.concat(F.lit("https://lh"), (F.col("user_id") % 7).cast("string"), F.lit(".googleusercontent.com/photograph-"), u, F.lit("=w"), F.col("event_id").cast("string"))
    url = F.when(k == 0, clip).when(k == 1, webp).when(k == 2, sized).when(k == 3, "https://i1.ytimg.com/other/abcdefgh/x.jpg").otherwise("https://a.example/x.jpg")
    return T(s, d, "events").select("event_id", urls.image_variant_key(url).alias("key"))


@query("URL12_endpoint_key", "SELECT page_id, regexp_extract(url, '^[^?#]*') AS endpoint FROM pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", urls.endpoint_key(F.col("url")).alias("endpoint"))


@query("URL13_auth_redirect_identity", cte("blocked") + "SELECT url, count(*) AS n, CASE WHEN contains(url, '/login/') THEN rtrim(url, '/') END AS identity FROM blocked GROUP BY ALL")
def _(s, d):
    return view(s, d, "blocked").groupBy("url").agg(F.count("*").alias("n")).withColumn("identity", urls.auth_redirect_identity(F.col("url")))


IP = "((event_id * 37) % 256) || '.' || ((event_id * 11) % 256) || '.' || (user_id % 256) || '.7'"


@query("URL14_public_ip", f"""
WITH a AS (SELECT event_id, {IP} AS ip, (event_id * 37) % 256 AS o1, (event_id * 11) % 256 AS o2, user_id % 256 AS o3 FROM events)
SELECT event_id, ip, NOT (o1 IN (0, 10, 127) OR o1 >= 224 OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 0 AND o3 IN (0, 2)) OR (o1 = 192 AND o2 = 168)
  OR (o1 = 198 AND o2 IN (18, 19)) OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113)) AS public FROM a""")
def _(s, d):
    ip = F.concat_ws(".", ((F.col("event_id") * 37) % 256).cast("string"), ((F.col("event_id") * 11) % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("7"))
    return T(s, d, "events").select("event_id", ip.alias("ip"), urls.is_public_ip(ip).alias("public"))


@query("URL15_file_like", cte("resources") + f"SELECT DISTINCT url, regexp_matches({PATH.format('url')}, '\\.(mp4|png|jpg|woff2)$') AS file_like FROM resources")
def _(s, d):
    return view(s, d, "resources").select("url").distinct().withColumn("file_like", urls.looks_like_file(F.col("url")))


@query("URL16_safe_url", f"""
SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') || '/[segments:' || len(list_filter(string_split({PATH.format('url')}, '/'), lambda x: x <> '')) || ';ext:' || coalesce(nullif(regexp_extract({PATH.format('url')}, '.([.][^./]*)$', 1), ''), 'none') || ']' || CASE WHEN contains(url, '?') THEN '?keys=' || array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: CASE WHEN lower(split_part(x, '=', 1)) IN ('width', 'page', 'variant', 'v') THEN split_part(x, '=', 1) ELSE '[redacted-key]' END))), ',') ELSE '' END
  || '#id=' || substr(sha256('key' || regexp_replace(url, '#.*$', '')), 1, 16) AS safe FROM pages""")
def _(s, d):
    return T(s, d, "pages").select("page_id", urls.safe_url(F.col("url"), "key").alias("safe"))


@query("URL17_URL18_archived_path", "SELECT page_id, '/archive/' || page_id || '/resource?url=' || replace(url_encode(split_part(url, '#', 1)), '%2A', '*') || regexp_extract(url, '#.*$') AS path, url AS back FROM pages")
def _(s, d):
    path = urls.archived_path(F.col("page_id"), F.col("url"))
    return T(s, d, "pages").select("page_id", path.alias("path"), urls.original_target(path).alias("back"))


@query("URL19_page_seed", "SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS seed FROM pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", urls.page_seed(F.col("url")).alias("seed"))


# text functions

BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<script\\b[\\s\\S]*?</script\\s*>', ' ', 'gi'), '<style\\b[\\s\\S]*?</style\\s*>', ' ', 'gi'), '<noscript\\b[\\s\\S]*?</noscript\\s*>', ' ', 'gi'), '<!--[\\s\\S]*?-->', ' ', 'g')"
ENT = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"
SEARCH = "trim(regexp_replace(" + ENT.format("regexp_replace(" + BARE.format("html") + ", '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


@query("TXT1_search_text", f"SELECT page_id, {SEARCH} AS body FROM pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", text.html_to_search_text(F.col("html")).alias("body"))


LINES = "list_filter(list_transform(string_split(" + ENT.format("regexp_replace(regexp_replace(" + BARE.format("html") + f", '<(br|hr)\\b[^>]*>|</({fixed.BLOCK_END})>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')") + ", chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query("TXT2_lines", f"SELECT page_id, len({LINES}) AS n, sha256(array_to_string({LINES}, '|')) AS digest FROM pages")
def _(s, d):
    out = T(s, d, "pages").select("page_id", text.html_to_lines(F.col("html")).alias("l"))
    return out.select("page_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("digest"))


@query("TXT3_compact_text", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[\\s\\S]*?</script>', ' ', 'gi'), '<style\\b[\\s\\S]*?</style>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS body FROM pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", text.compact_text(F.col("html")).alias("body"))


ENCODED = "replace(replace(replace(url_encode(x), '%2F', '/'), '%2C', ','), '%40', '@')"


@query("TXT4_links", f"""
WITH l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS x FROM pages)
SELECT DISTINCT page_id, CASE WHEN x LIKE 'http%' THEN x ELSE origin || {ENCODED} END AS dst FROM l WHERE x LIKE '/%' OR x LIKE 'http%'""")
def _(s, d):
    return P.page_links(T(s, d, "pages")).select("page_id", "dst")


@query("TXT5_asset_references", f"""
WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS o, regexp_extract(url, '^https?://[^/?#]*') || CASE WHEN {PATH.format('url')} = '' THEN '/' ELSE regexp_replace({PATH.format('url')}, '[^/]*$', '') END AS dir FROM pages)
SELECT page_id, o || '/i/' || page_id || '.png' AS ref FROM u UNION ALL SELECT page_id, dir || unnest(['a.png', 'b,c.png', 'fav.ico', 'bg.png']) FROM u""")
def _(s, d):
    extra = F.concat("html", F.lit("<img src=\"/i/"), F.col("page_id").cast("string"), F.lit(".png\" srcset=\"a.png 1x, b,c.png 2x\"><link rel=\"icon\" href=\"fav.ico\"><div style=\"background:url(bg.png)\"></div>"))
    return P.asset_references(T(s, d, "pages").withColumn("html", extra))


@query("TXT5_token_references", f"""
WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS o, regexp_extract(url, '^https?://[^/?#]*') || CASE WHEN {PATH.format('url')} = '' THEN '/' ELSE regexp_replace({PATH.format('url')}, '[^/]*$', '') END AS dir FROM pages)
SELECT page_id, o || '/i/' || page_id || '.png' AS ref FROM u UNION ALL SELECT page_id, dir || unnest(['a.png', 'b,c.png', 'fav.ico', 'bg.png', 'plain.webp', 'st.png']) FROM u""")
def _(s, d):
    k = F.col("page_id").cast("string")
    extra = F.concat("html", F.lit('<img alt="a > b <img src=no.png>" src="/i/'), k, F.lit('.png" srcset="a.png 1x, b,c.png 2x"><!-- <img src=gone.png> --><link rel="icon" title=\'x>y\' href="fav.ico"><div style="background:url(bg.png)"></div>'),
                     F.lit("<script>var x = '<img src=never.png>';</script><IMG SRC=plain.webp><style>p{background:url(st.png)}</style><img data-x='\"' alt=\"src='lost.png'\">"))
    return P.token_references(T(s, d, "pages").withColumn("html", extra))


@query("TXT6_css_references", "SELECT page_id, 'https://c.example/s/a' || page_id || '.png' AS ref FROM pages UNION SELECT page_id, 'https://c.example/b' || (page_id % 3) || '.css' FROM pages WHERE page_id % 2 = 0 UNION SELECT page_id, 'https://d.example/' || unnest(range(page_id % 4)) || '/f.woff2' FROM pages")
def _(s, d):
    k = F.col("page_id").cast("string")
    fonts = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit('src: url("//d.example/'), (i - 1).cast("string"), F.lit('/f.woff2#iefix") format("woff2");')))), "")
    rule = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('@import "/b'), (F.col("page_id") % 3).cast("string"), F.lit('.css";'))).otherwise("@import url(data:text/css,x);")
    css = F.concat(F.lit("a{background:url('a"), k, F.lit(".png')} b{background:URL( a"), k, F.lit(".png )} "), rule, F.coalesce(fonts, F.lit("")), F.lit(" c{background:url(data:x)}"))
    return T(s, d, "pages").select("page_id", F.explode(text.css_references(css, F.lit("https://c.example/s/m.css"))).alias("ref"))


@query("TXT7_base_href", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://b.example/' || page_id || '/' ELSE url END AS base FROM pages")
def _(s, d):
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<base href=\"https://b.example/"), F.col("page_id").cast("string"), F.lit("/\">"), F.col("html"))).otherwise(F.col("html"))
    return T(s, d, "pages").select("page_id", text.document_base(html, F.col("url")).alias("base"))


@query("TXT8_srcset", "SELECT page_id, unnest(CASE page_id % 4 WHEN 0 THEN ['a' || page_id || '.png', 'b,c.png', 'd.png'] WHEN 1 THEN ['one.png'] WHEN 2 THEN list_transform(range(page_id % 9), lambda i: 'w' || i || '.webp') ELSE ['p.png', 'q(1,2).png'] END) AS u FROM pages")
def _(s, d):
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 4
    many = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 9).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("w"), (i - 1).cast("string"), F.lit(".webp "), (i * 100).cast("string"), F.lit("w")))), lambda x: x.isNotNull()), " ,\n ")
    value = F.when(n == 0, F.concat(F.lit("a"), k, F.lit(".png 1x, b,c.png 2x,d.png"))).when(n == 1, "  one.png  ").when(n == 2, many).otherwise("p.png (max-width: 3px, x), q(1,2).png 2x")
    return T(s, d, "pages").select("page_id", F.explode(P.srcset_urls(value)).alias("u"))


@query("TXT9_script_references", """SELECT page_id, 'https://s.example/a/m' || page_id || '.js' AS ref FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'https://s.example/lib/x.mjs' FROM pages WHERE page_id % 3 < 2
UNION ALL SELECT page_id, 'https://s.example/c' || (page_id % 5) || '.css?v=1' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'https://t' || (page_id % 4) || '.example/' || unnest(['a.js', 'b.js?x=1&y=2']) FROM pages WHERE page_id % 3 = 2""")
def _(s, d):
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 3
    first = F.concat(F.lit("load('./m"), k, F.lit(".js'); import(\"/lib\\/x.mjs\"); plain('y.js'); load('./m"), k, F.lit(".js')"))
    second = F.concat(F.lit("s = `/c"), (F.col("page_id") % 5).cast("string"), F.lit(".css?v=1`; import( '../lib/x.mjs' ); x = '/a b.js'"))
    host = F.concat(F.lit("'https://t"), (F.col("page_id") % 4).cast("string"), F.lit(".example/"))
    third = F.concat(host, F.lit("a.js', "), host, F.lit("b.js?x=1&amp;y=2', '/i.png', \"data:text/javascript,x.js\""))
    js = F.when(n == 0, first).when(n == 1, second).otherwise(third)
    return T(s, d, "pages").select("page_id", F.explode(text.script_references(js, F.lit("https://s.example/a/b.js"))).alias("ref"))


@query("TXT10_hls", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['https://m.example/v/low' || page_id || '.m3u8', 'https://m.example/audio.m3u8'] ELSE [] END AS playlists,
 list_concat(list_transform(range(page_id % 4), lambda i: 'https://m.example/v/s' || i || '.ts'), CASE WHEN page_id % 3 = 0 THEN ['https://m.example/v/key.bin'] ELSE [] END) AS segments FROM pages""")
def _(s, d):
    k = F.col("page_id")
    master = F.when(k % 2 == 0, F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH=1\nlow"), k.cast("string"), F.lit('.m3u8\n#EXT-X-MEDIA:TYPE=AUDIO,URI="/audio.m3u8"\n'))).otherwise("")
    parts = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("#EXTINF:4,\r\ns"), (i - 1).cast("string"), F.lit(".ts\n")))), lambda x: x.isNotNull()), "")
    body = F.concat(F.lit("#EXTM3U\n"), master, parts, F.when(k % 3 == 0, '#EXT-X-KEY:METHOD=AES,URI="key.bin"').otherwise("#EXT-X-ENDLIST"), F.when(k % 4 > 0, "\ns0.ts").otherwise(""))
    return T(s, d, "pages").select("page_id", text.hls_targets(body, F.lit("https://m.example/v/i.m3u8")).alias("h")).select("page_id", "h.playlists", "h.segments")


@query("TXT12_iso_duration", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 5 * 86400 + user_id * 60 + 1.5 AS DOUBLE) WHEN 1 THEN CAST(user_id * 3600 AS DOUBLE) WHEN 2 THEN round(value, 2) END AS seconds FROM events")
def _(s, d):
    n, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    whole = F.concat(F.lit("P"), (F.col("event_id") % 5).cast("string"), F.lit("DT"), u, F.lit("M1.5S"))
    value = F.when(n == 0, whole).when(n == 1, F.concat(F.lit("pt"), u, F.lit("h"))).when(n == 2, F.concat(F.lit("PT"), F.round("value", 2).cast("string"), F.lit("S"))).otherwise(F.concat(u, F.lit(" seconds")))
    return T(s, d, "events").select("event_id", text.iso_duration_seconds(value).alias("seconds"))


@query("TXT13_content_range", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 10 WHEN 1 THEN user_id END AS total FROM events")
def _(s, d):
    n = F.col("event_id") % 4
    value = F.when(n == 0, F.concat(F.lit("bytes 0-9/ "), (F.col("event_id") * 10).cast("string"), F.lit(" "))).when(n == 1, F.concat(F.lit("bytes */"), F.col("user_id").cast("string"))).when(n == 2, "bytes 0-9/*")
    return T(s, d, "events").select("event_id", text.content_range_total(value).alias("total"))


@query("TXT14_charset", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'shift_jis' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'euc-jp' WHEN 3 THEN 'utf-8' WHEN 4 THEN 'gbk' ELSE 'utf-16le' END AS charset FROM pages")
def _(s, d):
    n = F.col("page_id") % 6
    mime = F.when(n.isin(0, 3), 'text/html; charset="Shift_JIS"').when(n == 4, "text/css").when(n == 1, "text/html; charset=unheard-of").otherwise("text/html")
    body = F.encode(F.when(n == 2, F.regexp_replace("html", "utf-8", "euc-jp")).when(n == 4, F.concat(F.lit('@charset "GB2312"; '), "html")).otherwise(F.col("html")), "UTF-8")
    mark = F.when(n == 3, F.unhex(F.lit("EFBBBF"))).when(n == 5, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    return T(s, d, "pages").select("page_id", text.detect_charset(mime, F.concat(mark, body)).alias("charset"))


@query("TXT16_TXT17_content_type", cte("resources") + "SELECT DISTINCT mime_type, CASE WHEN mime_type = '' THEN '' ELSE mime_type || '; charset=utf-8' END AS typed, mime_type IN ('text/javascript', 'text/css', 'text/html', 'application/json') AS textual FROM resources")
def _(s, d):
    m = F.col("mime_type")
    return view(s, d, "resources").select("mime_type").distinct().select(m, text.with_charset(m).alias("typed"), text.is_textual(m).alias("textual"))


@query("TXT18_TXT19_digests", "SELECT event_id, sha256(props) AS request, sha256('{\"k\":' || regexp_extract(props, '[0-9]+') || '}') AS canonical FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", text.request_digests(F.col("props")).alias("g")).select("event_id", "g.request", "g.canonical")


@query("TXT20_body_leaves", """SELECT event_id AS id, unnest(['a.0', 'a.1.k', 'b', 'e']) AS path, unnest(['1', regexp_extract(props, '[0-9]+'), event_type, '{}']) AS value FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, unnest(['user', 'q']), unnest([CAST(user_id AS VARCHAR), event_type || ' x']) FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, i || '.v', CAST(user_id + i AS VARCHAR) FROM events, range(3) t(i) WHERE event_id % 3 = 2 AND i <= event_id % 4""")
def _(s, d):
    n, u = F.col("event_id") % 3, F.col("user_id")
    nested = F.concat(F.lit('{"a":[1,'), F.col("props"), F.lit('],"b":"'), F.col("event_type"), F.lit('","e":{}}'))
    form = F.concat(F.lit("user="), u.cast("string"), F.lit("&q="), F.col("event_type"), F.lit("%20x"))
    listed = F.to_json(F.transform(F.sequence(F.lit(0), F.least(F.col("event_id") % 4, F.lit(2)).cast("int")), lambda i: F.struct((u + i).alias("v"))))
    body = F.when(n == 0, nested).when(n == 1, form).otherwise(listed)
    return R.body_leaves(T(s, d, "events").select(F.col("event_id").alias("id"), body.alias("body")))


@query("TXT21_identity_leaf", "SELECT event_id, event_id % 6 IN (0, 2, 3) AS identity FROM events")
def _(s, d):
    u = F.col("user_id").cast("string")
    paths = [F.concat(F.lit("a.videoId."), u), F.lit("a.video"), F.lit("ID"), F.concat(F.lit("variables."), u, F.lit(".handle")), F.concat(F.lit("id."), u, F.lit(".name")), F.lit("valid")]
    path = F.element_at(F.array(*paths), (F.col("event_id") % 6 + 1).cast("int"))
    return T(s, d, "events").select("event_id", path.rlike(fixed.IDENTITY_LEAF).alias("identity"))


@query("TXT24_clean_tags", cte("archives") + "SELECT archive_id, len(list_distinct(list_filter(list_transform(string_split(tags_text, ','), lambda x: trim(x)), lambda x: x <> ''))) AS n FROM archives")
def _(s, d):
    return view(s, d, "archives").select("archive_id", F.size(text.clean_tags(F.col("tags_text"))).cast("long").alias("n"))


@query("TXT25_redact", "SELECT doc_id, len(regexp_extract_all(substr(text, 1, 1000), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[a-zA-Z]{2,}')) AS masked FROM documents WHERE text IS NOT NULL")
def _(s, d):
    docs = T(s, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(F.regexp_extract_all(text.redact(F.col("text")), F.lit(r"\[email-redacted\]"), F.lit(0))).cast("long").alias("masked"))


@query("TXT27_lightweight_html", "SELECT page_id, regexp_replace(html, '<script\\b[^>]*>[\\s\\S]*?</script\\s*>', '', 'gi') AS light FROM pages")
def _(s, d):
    on = F.regexp_replace("html", "<nav>", "<nav onclick=\"x()\" onload='y'>")
    return T(s, d, "pages").select("page_id", text.lightweight_html(on).alias("light"))


@query("TXT29_wildcard", "SELECT page_id, url ILIKE '%.example.com/fr/%' AS hit FROM pages")
def _(s, d):
    return T(s, d, "pages").select("page_id", F.regexp_like("url", text.wildcard_regex(F.lit("*.example.com/FR/*"))).alias("hit"))


@query("TXT30_url_patterns", cte("archives") + "SELECT archive_id, ['*' || folder || '*', 'http*x'] AS patterns FROM archives WHERE folder IS NOT NULL")
def _(s, d):
    lines = F.concat(F.lit("# note\n"), F.col("folder"), F.lit("\nhttp*x\n\n"), F.col("folder"))
    return view(s, d, "archives").filter("folder is not null").select("archive_id", text.url_patterns(lines).alias("patterns"))


@query("TXT31_export_name", cte("archives") + "SELECT archive_id, title || '-' || strftime(saved_at, '%Y%m%d') || '.wacz' AS name FROM archives")
def _(s, d):
    return view(s, d, "archives").select("archive_id", text.export_file_name(F.col("title"), F.col("saved_at"), "wacz").alias("name"))


SIZE = "bytes * (CASE archive_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 300 WHEN 2 THEN 90000 ELSE 0 END) + archive_id % 1500"


@query("TXT32_readable_bytes", cte("archives") + f", b AS (SELECT archive_id, {SIZE} AS n FROM archives) SELECT archive_id, CASE WHEN n >= 1073741824 THEN format('{{:.1f}} GB', n / 1073741824.0) WHEN n >= 1048576 THEN format('{{:.1f}} MB', n / 1048576.0) WHEN n >= 1024 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' ELSE n || ' B' END AS label FROM b")
def _(s, d):
    return view(s, d, "archives").select("archive_id", text.readable_bytes(F.expr(SIZE)).alias("label"))

"""URL functions as Spark columns: parsing, resolving, scoping and keys.

A URL column becomes a struct of its parts once; all other functions are expressions over it, so they stay inside the JVM.
Unparsable or non-http(s) input gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import (
    ACCOUNT_HOSTS, ACCOUNT_SEGMENT, AUTH_PATH, CLIP_HOST, CLIP_PATH, DISPLAY_FILE, FILE_EXTENSION, GENERIC_KEYWORDS, IPV4_RANGES, LOGIN_WITH_SHOP, NOISE_HOST, NOISE_HOST_PATH, NOISE_PATH, PIXEL_PATH, PIXEL_WORKER,
    PRIVATE_SUFFIXES, SHOP_BOUNDARY, SIGN_IN_BOUNDARY, SIGNED_TOKEN, SIZED_HOST, TELEMETRY_HOST, TELEMETRY_PATH, TRACKING_KEYS, VIEWER_HOST, VIEWER_PATH, VOLATILE_KEY, VOLATILE_NAMES, VOLATILE_VALUE, COUNTER_IMAGE, COUNTRY_SUFFIXES, SUFFIX_EXCEPTIONS, WILDCARD_COUNTRIES,
)

URL = r"^([A-Za-z][A-Za-z0-9+.-]*):/{0,2}([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it; keeps nested expressions small."""
    return F.transform(F.array(value), body)[0]


def _escape(text: Column, keep: str) -> Column:
    """Percent-encode what a URL part may not hold; most texts hold nothing of that kind and pass as they are."""

    def encoded(t: Column) -> Column:
        one = lambda c: F.when(c.rlike(f"^[{keep}]*$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
        return F.when(t.rlike(f"^[{keep}]*$"), t).otherwise(F.array_join(F.transform(F.split(t, ""), one), ""))

    return let(text, encoded)


PATH_KEEP = r"!$-;=@-\[\]_a-z|~%&'()*+,\\"
QUERY_KEEP = r"!$-&(-;=?-~%"


def _clean_path(path: Column) -> Column:
    """Dot segments resolved; always begins with a slash."""
    dot = lambda x: F.lower(x).isin(".", "%2e")
    up = lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e")

    def resolved(segments: Column) -> Column:
        kept = F.aggregate(
            F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array().cast("array<string>"),
            lambda acc, x: F.when(up(x), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(dot(x), acc).otherwise(F.concat(acc, F.array(x))),
        )
        last = F.element_at(segments, -1)
        end = lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when((dot(last) | up(last)) & (F.size(k) > 0), "/").otherwise(""))
        return let(kept, end)

    def cleaned(p: Column) -> Column:
        simple = p.startswith("/") & ~p.rlike(r"(?i)\\|/(?:\.|%2e){1,2}(?:/|$)")
        return F.when(simple, p).when(p == "", "/").otherwise(let(F.split(F.regexp_replace(p, r"\\", "/"), "/"), resolved))

    return let(path, cleaned)


#: URLs that are canonical as they are: lower-case host without port, no dot segments, nothing to encode
CANONICAL = r"^https?://[a-z0-9.-]++(?:/(?!\.)[!$&'()*+,\-.0-9:;=@A-Z\[\]_a-z|~]*+)*+(?:\?[!$-&(-;=?-~]*+)?(?:#.*)?$"


def parts(url: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment, href, origin> of an absolute http(s) URL without credentials, else null.

    Canonical URLs are only cut; others are resolved and encoded. Where a URL is a column, ``parsed`` cuts it in generated code.
    """
    return let(F.trim(url), lambda t: F.when(t.rlike(CANONICAL), _cut(t)).otherwise(_resolved(t)))


def parsed(df: DataFrame, url: str, name: str = "_p") -> DataFrame:
    """``df`` with the parts of a URL column, worked out once a row: a generated column isn't put into the filters and join keys made from it."""
    t = F.trim(F.col(url))
    # every URL is cut, so that what the parts have in common is worked out once; it would not be within a condition
    cut = df.select("*", t.rlike(CANONICAL).alias("_canonical"), _cut(t).alias("_cut"))
    return cut.select(*df.columns, F.explode(F.array(F.when(F.col("_canonical"), F.col("_cut")).otherwise(_resolved(t)))).alias(name))


def _cut(t: Column) -> Column:
    """``parts`` of a canonical URL."""
    bare = F.substring_index(t, "#", 1)
    head = F.substring_index(bare, "?", 1)
    scheme = F.substring_index(t, ":", 1)
    rest = F.substr(head, F.length(scheme) + 4)
    host = F.substring_index(rest, "/", 1)
    path = F.concat(F.when(F.contains(rest, F.lit("/")), "").otherwise("/"), F.substr(rest, F.length(host) + 1))
    query, origin = F.substr(bare, F.length(head) + 1), F.concat(scheme, F.lit("://"), host)
    fields = {"scheme": scheme, "host": host, "port": F.lit(""), "path": path, "query": query, "fragment": F.substr(t, F.length(bare) + 1), "href": F.concat(origin, path, query), "origin": origin}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _resolved(url: Column) -> Column:
    """``parts`` of any URL."""

    def split(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, URL, i)
        return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))

    def named(r: Column) -> Column:
        host = F.lower(F.regexp_replace(r["authority"], r":[0-9]*$", ""))
        port = F.regexp_extract(r["authority"], r":([0-9]+)$", 1)
        port = F.when((r["scheme"] == "https") & (port == "443") | (r["scheme"] == "http") & (port == "80"), "").otherwise(port)
        ok = r["scheme"].isin("http", "https") & (r["authority"] != "") & ~r["authority"].contains("@") & ~host.rlike(r"[\s<>^|%]")
        return F.when(ok, F.struct(r["scheme"].alias("scheme"), host.alias("host"), port.alias("port"), _escape(_clean_path(r["path"]), PATH_KEEP).alias("path"), _escape(r["query"], QUERY_KEEP).alias("query"), r["fragment"].alias("fragment")))

    def joined(p: Column) -> Column:
        origin = F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))
        return F.when(p.isNotNull(), F.struct(*[p[k].alias(k) for k in ("scheme", "host", "port", "path", "query", "fragment")], F.concat(origin, p["path"], p["query"]).alias("href"), origin.alias("origin")))

    return let(url, lambda t: let(let(split(t), named), joined))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Canonical absolute URL without fragment; relative input is resolved against ``base``. Null for other schemes and credentials."""
    if base is None:
        return parts(url)["href"]

    def absolute(t: Column, b: Column) -> Column:
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
            .when(t.startswith("//"), F.concat(b["scheme"], F.lit(":"), t))
            .when(t.startswith("/"), F.concat(b["origin"], t))
            .when((t == "") | t.startswith("#"), b["href"])
            .when(t.startswith("?"), F.concat(b["origin"], b["path"], t))
            .otherwise(F.concat(b["origin"], F.regexp_replace(b["path"], "[^/]*$", ""), t))
        )

    return parts(let(F.trim(url), lambda t: let(parts(base), lambda b: absolute(t, b))))["href"]


def is_ip(host: Column) -> Column:
    return host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$") | host.rlike(r"^\[?[0-9a-f:]*:[0-9a-f:.]*\]?$")


def registrable_domain(host: Column) -> Column:
    """The label in front of the public suffix, with the suffix; addresses as they are.

    Suffixes: the listed ones below countries (co.jp, edu.au), any label below some (x.ck, but for the exceptions), the listed private ones (github.io, s3.amazonaws.com), else
    the last label. ``operators.suffixes`` joins hosts with a whole suffix table.
    """

    listed = {n: [x for x in PRIVATE_SUFFIXES if x.count(".") == n - 1] for n in (2, 3)}
    listed[2] += [f"{second}.{country}" for country, seconds in COUNTRY_SUFFIXES.items() for second in seconds.split()]

    def named(labels: Column) -> Column:
        last = lambda n: F.concat_ws(".", F.slice(labels, -n, n))

        def cut(two: Column) -> Column:
            wild = last(1).isin(WILDCARD_COUNTRIES) & ~two.isin(SUFFIX_EXCEPTIONS)
            suffix = F.when((F.size(labels) >= 3) & last(3).isin(listed[3]), 3).when((F.size(labels) >= 2) & (two.isin(listed[2]) | wild), 2).otherwise(1)
            return let(F.least(F.size(labels), suffix + 1), last)

        return let(last(2), cut)

    domain = lambda h: F.when(is_ip(h), h).otherwise(let(F.split(h, r"\."), named))
    return let(F.lower(F.regexp_replace(host, r"^\[|\]$", "")), domain)


def keyword_matches_host(host: Column, keyword: Column) -> Column:
    return F.exists(F.split(F.lower(host), r"\."), lambda label: (label == keyword) | F.array_contains(F.split(label, "-"), keyword))


def normalize_keywords(text: Column) -> Column:
    """At most ten distinct keywords of 4 to 32 characters that are neither numbers nor generic."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\s,]+"), lambda w: F.lower(F.trim(w)))
    return F.slice(F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-z0-9-]{4,32}$") & ~w.rlike(r"^\d+$") & ~w.isin(GENERIC_KEYWORDS))), 1, 10)


def validate_keywords(text: Column) -> Column:
    """``normalize_keywords``, or an error if a keyword is dropped or there are more than ten."""
    given = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,]+"), lambda w: w != "")
    kept = normalize_keywords(text)
    bad = (F.size(given) > 10) | (F.size(kept) != F.size(F.array_distinct(F.transform(given, F.lower))))
    return F.when(bad, F.raise_error(F.lit("keywords need 4 to 32 letters, digits or hyphens and must be specific"))).otherwise(kept)


def classify_scope(start: Column, candidate: Column, keywords: Column | None = None) -> Column:
    """origin, site, keyword-site or external."""
    a, b = parts(start), parts(candidate)
    out = F.when(a["origin"] == b["origin"], "origin").when(registrable_domain(a["host"]) == registrable_domain(b["host"]), "site")
    if keywords is not None:
        out = out.when(F.exists(keywords, lambda k: keyword_matches_host(a["host"], k) & keyword_matches_host(b["host"], k)), "keyword-site")
    return out.otherwise("external")


def next_external_depth(candidate_scope: Column, current_scope: Column, depth: Column) -> Column:
    """0 inside the site, 1 on leaving it, one more for each step outside."""
    return F.when(candidate_scope != "external", 0).when(current_scope == "external", F.greatest(F.lit(1), F.coalesce(depth, F.lit(1))) + 1).otherwise(1)


def site_of(url: Column) -> Column:
    """struct<origin, domain> of a URL: what its scope is told by."""
    return let(parts(url), lambda p: F.struct(p["origin"].alias("origin"), registrable_domain(p["host"]).alias("domain")))


def _outside(start: Column, site: Column) -> Column:
    """Whether ``classify_scope`` of two sites is external."""
    return ~F.coalesce(start["origin"] == site["origin"], F.lit(False)) & ~F.coalesce(start["domain"] == site["domain"], F.lit(False))


def external_depth_between(start: Column, source: Column, depth: Column, target: Column) -> Column:
    """``redirect_external_depth`` of sites."""
    reached = F.greatest(F.lit(1), F.coalesce(depth, F.lit(1)))
    same = F.coalesce(source["domain"] == target["domain"], F.lit(False))
    return F.when(~_outside(start, target), 0).when(same, reached).when(_outside(start, source), reached + 1).otherwise(1)


def chain_depth_between(start: Column, requested: Column, depth: Column, final: Column) -> Column:
    """``redirect_chain_depth`` of sites."""
    reached = F.greatest(F.lit(1), F.coalesce(depth, F.lit(1)))
    left = _outside(start, requested)
    same = F.coalesce(requested["domain"] == final["domain"], F.lit(False))
    return F.when(~_outside(start, final), 0).when(same & left, reached).when(same, 1).when(left, reached + 1).otherwise(1)


def redirect_external_depth(start: Column, source: Column, depth: Column, target: Column) -> Column:
    return let(F.array(site_of(start), site_of(source), site_of(target)), lambda s: external_depth_between(s[0], s[1], depth, s[2]))


def redirect_chain_depth(start: Column, requested: Column, depth: Column, final: Column) -> Column:
    return let(F.array(site_of(start), site_of(requested), site_of(final)), lambda s: chain_depth_between(s[0], s[1], depth, s[2]))


def depth_warning(scope: Column, depth: Column, external_depth: Column, site_limit: int | None = 30, external_limit: int | None = 5) -> Column:
    """struct<metric, threshold, depth> where a depth has reached its limit (null limit: never), else null."""
    outside = scope == "external"
    measured = F.when(outside, F.greatest(F.lit(1), F.coalesce(external_depth, F.lit(1)))).otherwise(depth)
    limit = F.when(outside, F.lit(external_limit).cast("int")).otherwise(F.lit(site_limit).cast("int"))
    return F.when(measured >= limit, F.struct(F.when(outside, "externalDepth").otherwise("depth").alias("metric"), limit.alias("threshold"), measured.alias("depth")))


def query_pairs(query: Column) -> Column:
    """array<struct<name, value>> of a query with its question mark, decoded."""
    items = F.filter(F.split(F.when(F.startswith(query, F.lit("?")), F.substr(query, F.lit(2))).otherwise(query), "&"), lambda p: p != "")
    # most names and values have nothing to decode
    decode = lambda s: F.when(F.contains(s, F.lit("%")) | F.contains(s, F.lit("+")), F.coalesce(F.try_url_decode(s), s)).otherwise(s)
    name = lambda p: F.substring_index(p, "=", 1)
    return F.transform(items, lambda p: F.struct(decode(name(p)).alias("name"), decode(F.substr(p, F.length(name(p)) + 2)).alias("value")))


def _filter_query(url: Column, drop) -> Column:
    """The URL without the query items that ``drop`` (raw name, decoded value) says; unchanged if there is none."""

    def of(p: Column) -> Column:
        items = F.filter(F.split(F.regexp_replace(p["query"], r"^\?", ""), "&"), lambda i: i != "")
        name = lambda i: F.substring_index(i, "=", 1)
        value = lambda i: F.regexp_extract(i, "(?s)^[^=]*=(.*)$", 1)
        # a dropped name goes with all its values
        dropped = F.transform(F.filter(items, lambda i: drop(name(i), value(i))), name)
        kept = F.filter(items, lambda i: ~F.array_contains(dropped, name(i)))
        rebuilt = F.concat(p["origin"], p["path"], F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")), p["fragment"])
        return F.when(F.size(dropped) > 0, rebuilt).otherwise(url)

    return let(parts(url), of)


def stable_document_key(url: Column) -> Column:
    """Without session parameters and signed tokens; the input itself if it has none or can't be parsed."""
    return F.coalesce(_filter_query(url, lambda n, v: F.lower(n).isin(VOLATILE_NAMES) | v.rlike(SIGNED_TOKEN)), url)


def apply_query_policy(url: Column, policy: str = "keep") -> Column:
    """keep, drop-tracking or drop-all."""

    def of(p: Column) -> Column:
        if policy == "drop-all":
            return F.concat(p["origin"], p["path"], p["fragment"])
        if policy == "drop-tracking":
            return _filter_query(F.concat(p["href"], p["fragment"]), lambda n, v: n.rlike(TRACKING_KEYS))
        return F.concat(p["href"], p["fragment"])

    return let(parts(url), of)


def surt_key(url: Column) -> Column:
    """Sort key: labels reversed, www dropped, path and sorted query in lower case."""

    def of(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"^www\d*\.", "")
        pairs = F.array_sort(query_pairs(p["query"]))
        query = F.lower(F.array_join(F.transform(pairs, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "&"))
        port = F.when(p["port"].isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
        key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.lower(p["path"]), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")))
        return F.coalesce(key, url)

    return let(parts(url), of)


def timestamp14(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def volatile_param(name: Column, value: Column) -> Column:
    return name.rlike(VOLATILE_KEY) | value.rlike(VOLATILE_VALUE)


def stable_query(url: Column) -> Column:
    """Sorted query items that don't change between visits, as JSON."""
    return stable_query_of(parts(url))


def stable_query_of(p: Column) -> Column:
    """``stable_query`` of a URL's parts."""
    kept = F.filter(query_pairs(p["query"]), lambda x: ~volatile_param(x["name"], x["value"]))
    return F.coalesce(F.to_json(F.transform(F.sort_array(kept), lambda x: F.array(x["name"], x["value"]))), F.lit("[]"))


def image_variant_key(url: Column) -> Column:
    """Equal for the sizes of one image on the two known image hosts."""
    return let(parts(url), image_variant_key_of)


def image_variant_key_of(p: Column) -> Column:
    """``image_variant_key`` of a URL's parts."""
    base = F.substring_index(p["path"], "=", 1)
    clip = F.regexp_extract(p["path"], CLIP_PATH, 1)
    sized = p["host"].rlike(SIZED_HOST)
    return F.when(sized & (F.length(base) > 8), F.concat(F.lit("sized:"), p["host"], base)).when(~sized & p["host"].rlike(CLIP_HOST) & (clip != ""), F.concat(F.lit("ytimg:"), clip))


def endpoint_of(p: Column, url: Column) -> Column:
    """``endpoint_key`` of a URL and its parts."""
    return F.coalesce(F.concat(p["origin"], p["path"]), url, F.lit(""))


def endpoint_key(url: Column) -> Column:
    return let(parts(url), lambda p: endpoint_of(p, url))


def auth_redirect_identity(url: Column) -> Column:

    def of(p: Column) -> Column:
        path = F.lower(p["path"])
        trimmed = F.regexp_replace(path, "/+$", "")
        return F.when(path.rlike(AUTH_PATH), F.concat(p["origin"], F.when(trimmed == "", "/").otherwise(trimmed)))

    return let(parts(url), of)


def is_public_ip(ip: Column) -> Column:
    """False for private, reserved and malformed addresses."""
    four = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"

    def reserved(address: Column) -> Column:
        number = F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
        out = F.lit(False)
        for base, bits in IPV4_RANGES:
            low = sum(int(o) << s for o, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
            out = out | number.between(low, low + (1 << (32 - bits)) - 1)
        return out

    six = F.lower(ip)
    mapped = F.regexp_extract(six, "^::ffff:(.*)$", 1)
    private6 = six.isin("::", "::1") | six.rlike("^(?:fc|fd|fe8|fe9|fea|feb|ff)")
    is6 = six.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$")
    return F.when(ip.rlike(four), ~reserved(ip)).when(is6 & mapped.rlike(four), ~reserved(mapped)).when(is6, ~private6).otherwise(False)


def looks_like_file(url: Column) -> Column:
    path = parts(url)["path"]
    return F.coalesce(F.coalesce(F.try_url_decode(path), path).rlike(FILE_EXTENSION), F.lit(False))


def safe_url(url: Column, key: str) -> Column:
    """Origin, number of segments, extension, allowed query names and a keyed digest; nothing else of the URL is left."""

    def of(p: Column) -> Column:
        segments = F.size(F.filter(F.split(p["path"], "/"), lambda s: s != ""))
        ext = F.lower(F.substring(F.regexp_extract(F.element_at(F.split(p["path"], "/"), -1), r"^.+(\.[^.]*)$", 1), 1, 12))
        names = F.array_sort(F.array_distinct(F.transform(query_pairs(p["query"]), lambda x: F.when(F.lower(x["name"]).isin("width", "page", "variant", "v"), x["name"]).otherwise("[redacted-key]"))))
        digest = F.substring(F.sha2(F.concat(F.lit(key), p["href"]), 256), 1, 16)
        made = F.concat(p["origin"], F.lit("/[segments:"), segments.cast("string"), F.lit(";ext:"), F.when(ext == "", "none").otherwise(ext), F.lit("]"), F.when(F.size(names) > 0, F.concat(F.lit("?keys="), F.array_join(names, ","))).otherwise(""), F.lit("#id="), digest)
        done = url.rlike(r"(?i)^https?://[^/]+/\[segments:\d+;ext:[^\]]+\](?:\?keys=[^#]*)?#id=[a-f0-9]{16}$")
        return F.when(done, url).otherwise(F.coalesce(made, F.regexp_replace(F.substring(url, 1, 300), r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}", "[email-redacted]")))

    return let(parts(url), of)


def archived_path(archive_id: Column, url: Column) -> Column:
    """Where a saved resource is served; a fragment stays behind."""
    body, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(F.lit("/archive/"), F.url_encode(archive_id.cast("string")), F.lit("/resource?url="), F.url_encode(body), fragment)


def original_target(path: Column) -> Column:
    """The URL inside an archived path."""
    fragment = F.regexp_extract(path, "(#.*)$", 1)
    return F.concat(F.try_url_decode(F.nullif(F.regexp_extract(path, r"^/archive/[^/]+/resource\?url=([^#&]*)", 1), F.lit(""))), fragment)


def page_seed(url: Column) -> Column:
    """FNV-1a over code points, 32 bits."""
    prime, mask = 0x01000193, 0xFFFFFFFF
    step = lambda h, c: F.lit(mask).bitwiseAND((h.bitwiseXOR(F.ascii(c).cast("long"))) * prime)
    return F.aggregate(F.filter(F.split(F.coalesce(url, F.lit("")), ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("long"), step)


# predicates on URLs


def is_server_boundary(url: Column) -> Column:
    """Login and payment end points that only answer live."""
    return let(parts(url), boundary_of)


def boundary_of(p: Column) -> Column:
    """``is_server_boundary`` of a URL's parts."""
    host, path = p["host"], p["path"]
    shop = (host == "shop.app") & path.rlike(SHOP_BOUNDARY)
    sign_in = (host == "accounts.google.com") & path.rlike(SIGN_IN_BOUNDARY)
    viewer = host.rlike(VIEWER_HOST) & path.rlike(VIEWER_PATH)
    return F.coalesce(shop | sign_in | path.rlike(LOGIN_WITH_SHOP) | viewer, F.lit(False))


def is_auxiliary(url: Column) -> Column:
    """Telemetry and pixels that a saved page does without."""
    return let(parts(url), auxiliary_of)


def auxiliary_of(p: Column) -> Column:
    """``is_auxiliary`` of a URL's parts."""
    host, path = p["host"], p["path"]
    pixel = (host == COUNTER_IMAGE[0]) & (path == COUNTER_IMAGE[1])
    collector = path.rlike(TELEMETRY_PATH) & ~path.rlike(DISPLAY_FILE)
    return F.coalesce(pixel | path.rlike(PIXEL_PATH) | host.rlike(TELEMETRY_HOST) | collector | path.rlike(PIXEL_WORKER), F.lit(False))


def is_noise(url: Column, kind: Column) -> Column:
    """Trackers and advertisements."""

    def of(p: Column) -> Column:
        named = auxiliary_of(p) | p["host"].rlike(NOISE_HOST) | F.concat(p["host"], p["path"]).rlike(NOISE_HOST_PATH) | p["path"].rlike(NOISE_PATH)
        return F.coalesce(F.lower(kind).isin("ping", "cspviolationreport"), F.lit(False)) | F.coalesce(named, F.lit(False))

    return let(parts(url), of)


def is_account_like(url: Column) -> Column:
    return let(parts(url), account_of)


def account_of(p: Column) -> Column:
    """``is_account_like`` of a URL's parts."""
    return F.coalesce(p["host"].rlike(ACCOUNT_HOSTS) | p["path"].rlike(ACCOUNT_SEGMENT), F.lit(False))

"""HTML, CSS, playlist and JSON text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import AUTOPLAY, BLOCK_END, INLINE_HANDLER, SCRIPT_IMPORT, SCRIPT_LITERAL, SECRET_NAME, TEXT_TYPE
from .urls import let, normalize_url

NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _without(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def decode_entities(text: Column) -> Column:
    """Numeric and six named entities; others stay as they are. A text is cut at its entities, so each is decoded once; the text itself is made once too."""
    entity = r"&(?:#x[0-9a-fA-F]+|#\d+|[a-zA-Z]+);"

    def value(e: Column) -> Column:
        body = F.substring(e, 2, F.length(e) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, F.length(body)), 16, 10)).otherwise(F.substring(body, 2, F.length(body)))
        number = F.expr("0").cast("long") + F.when(F.length(code) <= 7, code.cast("long")).otherwise(F.lit(0))
        # a code point as four bytes of UTF-32
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        named = F.lower(body)
        out = F.when(body.startswith("#"), F.when((number > 0) & (number < 0x110000), char).otherwise(" "))
        for k, v in NAMED.items():
            out = out.when(named == k, F.lit(v))
        return out.otherwise(e)

    def decoded(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(entity), F.lit(0))
        pieces = F.split(t, entity, -1)
        joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.transform(found, value), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
        return F.when(t.contains("&"), joined).otherwise(t)

    return let(text, decoded)


#: White space but for the space and the line feed.
WHITE = r"\t\f\r\x0B\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def collapse(text: Column) -> Column:
    # a single space is no match: most words lie between such
    return F.trim(F.regexp_replace(text, rf"[\n{WHITE}][ \n{WHITE}]*| [ \n{WHITE}]+", " "))


def html_to_search_text(html: Column) -> Column:
    """All visible text on one line; null HTML is empty."""
    html = F.coalesce(html, F.lit(""))
    return collapse(decode_entities(F.regexp_replace(_without(html, "script", "style", "noscript"), "<[^>]+>", " ")))


def html_to_lines(html: Column) -> Column:
    """Visible text as lines, broken at block ends, br and hr."""
    html = _without(F.coalesce(html, F.lit("")), "script", "style", "noscript", "template")
    html = F.regexp_replace(html, r"(?i)<(?:br|hr)\b[^>]*>|</(?:" + BLOCK_END + ")>", "\n")
    # runs of white space within lines are collapsed in the whole text, so a line is only trimmed
    text = F.regexp_replace(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")), rf"[{WHITE}][ {WHITE}]*| [ {WHITE}]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def compact_text(html: Column) -> Column:
    """Rough body text for classification."""
    html = F.coalesce(html, F.lit(""))
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.substring(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "), 1, 200_000)


def html_title(html: Column) -> Column:
    return collapse(decode_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))


def attribute_decode(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))


def document_base(html: Column, page_url: Column) -> Column:
    """The base of relative URLs: a valid base element, or the page itself."""
    href = F.regexp_extract(html, r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]*)""", 1)
    return F.coalesce(F.when(href != "", normalize_url(attribute_decode(href), page_url)), page_url)


def _resolved(found: Column, base: Column) -> Column:
    usable = F.filter(found, lambda v: (v != "") & ~v.rlike("(?i)^(?:data:|blob:|about:|javascript:|#)"))
    return F.array_distinct(F.array_compact(F.transform(usable, lambda v: normalize_url(attribute_decode(v), base))))


def extract_links(html: Column, page_url: Column) -> Column:
    """Distinct canonical targets of a and area elements."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<(?:a|area)\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'[^']*')"""), F.lit(1))
    return _resolved(hrefs, page_url)


def css_references(css: Column, base: Column) -> Column:
    """Targets of url() and @import, distinct."""
    urls = F.regexp_extract_all(css, F.lit(r"""(?i)url\(\s*["']?([^)"']+)["']?\s*\)"""), F.lit(1))
    imports = F.regexp_extract_all(css, F.lit(r"""(?i)@import\s*["'](.*?)["']"""), F.lit(1))
    return _resolved(F.concat(urls, imports), base)


def script_references(text: Column, base: Column) -> Column:
    """Quoted script and style paths, and targets of import()."""
    source = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    return _resolved(F.concat(F.regexp_extract_all(source, F.lit(SCRIPT_LITERAL), F.lit(1)), F.regexp_extract_all(source, F.lit(SCRIPT_IMPORT), F.lit(1))), base)


def hls_targets(text: Column, base: Column) -> Column:
    """struct<playlists, segments> of an HLS playlist."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda line: line != "")
    start = F.struct(F.lit(False).alias("variant"), F.array().cast("array<string>").alias("playlists"), F.array().cast("array<string>").alias("segments"))

    def step(s: Column, line: Column) -> Column:
        tag, uri = line.startswith("#"), F.regexp_extract(line, r'(?i)\bURI="([^"]+)"', 1)
        raw = F.when(tag, F.nullif(uri, F.lit(""))).otherwise(line)
        target = normalize_url(raw, base)
        listed = F.when(tag, line.rlike("(?i)^#EXT-X-(?:MEDIA|I-FRAME-STREAM-INF)")).otherwise(s["variant"] | target.rlike(r"(?i)\.m3u8(?:[?#]|$)"))
        one = F.when(target.isNotNull(), F.array(target)).otherwise(F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        variant = F.when(tag, s["variant"] | line.rlike("(?i)^#EXT-X-STREAM-INF")).otherwise(s["variant"] & target.isNull())
        return F.struct(variant.alias("variant"), F.concat(s["playlists"], F.when(listed, one).otherwise(none)).alias("playlists"), F.concat(s["segments"], F.when(listed, none).otherwise(one)).alias("segments"))

    return F.aggregate(lines, start, step, lambda s: F.struct(F.array_distinct(s["playlists"]).alias("playlists"), F.array_distinct(s["segments"]).alias("segments")))


def iso_duration_seconds(text: Column) -> Column:
    pattern = r"(?i)^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def content_range_total(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"/\s*(\d+)\s*$", 1), F.lit("")).cast("long")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """DASH identifiers $Name$ and $Name%05d$; $$ is a dollar sign."""
    out = template
    for name, value in values.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        width = F.nullif(F.regexp_extract(out, rf"\${name}%0(\d+)d\$", 1), F.lit("")).cast("int")
        padded = F.lpad(text, F.greatest(F.coalesce(width, F.lit(0)), F.length(text)), "0")
        out = F.replace(F.regexp_replace(out, F.lit(rf"\${name}%0\d+d\$"), padded), F.lit(f"${name}$"), text)
    return F.replace(out, F.lit("$$"), F.lit("$"))


def is_textual(mime: Column) -> Column:
    return F.trim(F.coalesce(mime, F.lit(""))).rlike(TEXT_TYPE)


def with_charset(content_type: Column, charset: str = "utf-8") -> Column:
    kept = F.filter(F.transform(F.split(content_type, ";"), lambda s: F.trim(s)), lambda p: (p != "") & ~p.rlike(r"(?i)^charset\s*="))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "; "), F.lit(f"; charset={charset}"))).otherwise(content_type)


# fixed values: labels of encodings and the names they stand for
CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "shift_jis": "shift_jis", "shift-jis": "shift_jis", "sjis": "shift_jis", "x-sjis": "shift_jis", "windows-31j": "shift_jis", "euc-jp": "euc-jp", "x-euc-jp": "euc-jp", "iso-2022-jp": "iso-2022-jp", "iso-8859-1": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "windows-1252": "windows-1252", "utf-16": "utf-16le", "utf-16le": "utf-16le", "utf-16be": "utf-16be", "gbk": "gbk", "gb2312": "gbk", "gb18030": "gb18030", "big5": "big5", "euc-kr": "euc-kr"}


def charset_name(label: Column) -> Column:
    """The encoding a label stands for; null if unknown."""
    names = F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(F.regexp_replace(label, "^[\"']|[\"']$", ""))))


def detect_charset(content_type: Column, body: Column) -> Column:
    """Byte order mark, then header, then markup of the first 4096 bytes, then utf-8."""
    start = F.hex(F.substring(body, 1, 3))
    bom = F.when(start == "EFBBBF", "utf-8").when(start.startswith("FFFE"), "utf-16le").when(start.startswith("FEFF"), "utf-16be")
    mime = F.coalesce(content_type, F.lit(""))
    header = charset_name(F.regexp_extract(mime, r"""(?i);\s*charset\s*=\s*"?([^";\s]+)""", 1))
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    first = lambda *ps: F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in ps])
    meta = first(r"""(?i)<meta[^>]+charset\s*=\s*["']?([\w.:-]+)""", r"""(?i)<meta[^>]+content\s*=\s*["'][^"']*charset=([\w.:-]+)""", r"""(?i)<\?xml[^>]+encoding\s*=\s*["']([\w.:-]+)""")
    markup = F.when(mime.rlike("(?i)html|xml") | head.rlike(r"^\s*<"), charset_name(meta))
    css = F.when(mime.rlike("(?i)css"), charset_name(F.regexp_extract(head, r"""(?i)^@charset\s+["']([\w.:-]+)["']""", 1)))
    return F.coalesce(bom, header, markup, css, F.lit("utf-8"))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(text))


def request_digests(body: Column) -> Column:
    """struct<request, canonical>: digests of the body as it is and with sorted keys."""
    return F.struct(F.sha2(body, 256).alias("request"), F.when(canonical_json(body).isNotNull(), F.sha2(canonical_json(body), 256)).alias("canonical"))


def clean_label(text: Column, limit: int) -> Column:
    return F.substring(collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", " ")), 1, limit)


def clean_tags(text: Column) -> Column:
    """At most 20 distinct tags of a list with commas."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,、]"), lambda t: clean_label(t, 40)), lambda t: t != "")), 1, 20)


def wildcard_regex(pattern: Column) -> Column:
    """A pattern with * as an anchored expression that ignores case."""
    escaped = F.regexp_replace(pattern, r"[.+?^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("(?is)^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$"))


def url_patterns(text: Column) -> Column:
    """Pattern lines: comments skipped, bare words between stars, distinct, at most 50."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    return F.slice(F.array_distinct(F.transform(lines, lambda s: F.when(s.contains("*") | s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("*"), s, F.lit("*"))))), 1, 50)


def readable_bytes(n: Column) -> Column:
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    tenth = lambda v: F.format_string("%.1f", v)
    return (
        F.when(n >= 2**30, F.concat(tenth(n / 2**30), F.lit(" GB"))).when(n >= 2**20, F.concat(tenth(n / 2**20), F.lit(" MB")))
        .when(n >= 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))
    )


def lightweight_html(html: Column) -> Column:
    """Without scripts, inline handlers, autoplay and script links."""
    out = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<script\b[^>]*/>", "")
    for _ in range(8):  # several handlers in one tag
        out = F.regexp_replace(out, INLINE_HANDLER, "$1")
    out = F.regexp_replace(out, AUTOPLAY, "$1")
    return F.regexp_replace(out, r"""(?i)\bhref\s*=\s*(["'])\s*javascript:[^"']*\1""", 'href="#"')


def export_file_name(title: Column, saved_at: Column, extension: str) -> Column:
    safe = F.substring(F.regexp_replace(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("archive")), r'[\\/:*?"<>|\x00-\x1F]+', "_"), 1, 80)
    return F.concat(safe, F.lit("-"), F.date_format(saved_at, "yyyyMMdd"), F.lit(f".{extension}"))


def redact(text: Column) -> Column:
    """Log text without URLs, addresses and home folders."""
    out = F.regexp_replace(F.substring(text, 1, 1000), r"""(?i)https?://[^\s"']+""", "[url-redacted]")
    out = F.regexp_replace(out, r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}", "[email-redacted]")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)[a-z]:\\Users\\[^\\\s\"']+", "[user-profile]"), r"/(?:home|Users)/[^/\s\"']+", "[user-profile]")


def watch_text(text: Column) -> Column:
    return F.substring(collapse(F.coalesce(text, F.lit(""))), 1, 100_000)


def excerpt(text: Column, limit: int = 600) -> Column:
    t = watch_text(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)

"""Rule sets: predicates and classifications as Spark columns. Text tests read a null as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (
    ADVISORY_MESSAGE, BROWSER_START, CAPTURE_FAILURE, CHALLENGE_BODY, CHALLENGE_TITLE, DATA_TYPE, ERROR_TITLE, FONT_PATH, FONT_TYPE, IMAGE_PATH, IMAGE_TYPE, ISOLATION_ERROR, ISOLATION_MESSAGE, LOGIN_ISSUE_PATH, LOGIN_PATH, LOGIN_TITLE, MEDIA_PATH,
    MEDIA_TYPE, NETWORK_REASON, NOT_FOUND_REASON, OUT_OF_SCOPE, PAGE_TYPE, REFUSED_REASON, RETRYABLE_CODES, RETRYABLE_MESSAGE, SYSTEM_PATH, SYSTEM_TYPE, TIMEOUT_REASON, UNAVAILABLE_REASON,
)
from .text import compact_text, wildcard_regex
from .urls import account_of, boundary_of, let, parts


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def document_allowed(url: Column, includes: list[str], excludes: list[str]) -> Column:
    """Excludes win; includes count only if there are any."""
    any_of = lambda ps: reduce(lambda a, b: a | b, [F.expr("true") & F.regexp_like(url, wildcard_regex(F.lit(p))) for p in ps], F.lit(False))
    return ~any_of(excludes) & (any_of(includes) if includes else F.lit(True))


def resource_type_key(kind: Column) -> Column:
    out = F.lit("other")
    for key, names in {"stylesheet": ["Stylesheet"], "script": ["Script"], "image": ["Image"], "media": ["Media"], "font": ["Font"], "xhr": ["XHR", "Fetch"]}.items():
        out = F.when(kind.isin(names), key).otherwise(out)
    return out


def resource_type_allowed(kind: Column, off: list[str]) -> Column:
    """Documents always; else unless its key is switched off."""
    return (kind == "Document") | ~resource_type_key(kind).isin(off)


def good_resource(status: Column, size: Column, empty_confirmed: Column) -> Column:
    status = F.coalesce(status, F.lit(200))
    return (status < 400) & ((F.coalesce(size, F.lit(0)) > 0) | F.coalesce(empty_confirmed, F.lit(False)) | status.isin(204, 205))


def capture_failure(reason: Column) -> Column:
    return text(reason).rlike(CAPTURE_FAILURE)


def classify_page(start_url: Column, requested_url: Column, url: Column, title: Column, html: Column, status: Column) -> Column:
    """struct<classification, level, score>: access-challenge, login-required, error-page, missing-html or normal."""
    title, body = text(title), compact_text(html)
    challenge = title.rlike(CHALLENGE_TITLE) | (body.rlike(CHALLENGE_BODY) & ((F.length(body) < 12000) | ~text(html).rlike(r"(?i)<main\b")))
    path = lambda u: text(parts(u)["path"])
    redirected = F.coalesce((requested_url != "") & (url != "") & (requested_url != url), F.lit(False))
    sent_to_login = redirected & path(url).rlike("(?i)" + LOGIN_PATH.removeprefix("(?i)")) & ~path(F.coalesce(start_url, requested_url)).rlike(LOGIN_PATH)
    password = text(html).rlike(r"""(?i)<input\b[^>]*\btype\s*=\s*["']?password""")
    failed = F.coalesce(status >= 400, F.lit(False)) | title.rlike(ERROR_TITLE)
    out = lambda c, level, score: F.struct(F.lit(c).alias("classification"), F.lit(level).alias("level"), F.lit(score).alias("score"))
    return (
        F.when(challenge, out("access-challenge", "blocked", 0))
        .when(sent_to_login | (title.rlike(LOGIN_TITLE) & password), out("login-required", "blocked", 0))
        .when(failed, out("error-page", "failed", 0))
        .when(text(html) == "", out("missing-html", "failed", 0))
        .otherwise(out("normal", "verified", 100))
    )


def classify_title(title: Column, start_url: Column) -> Column:
    """Classification of an old record from its title; null if it says nothing."""
    title = text(title)
    login = title.rlike(LOGIN_TITLE) & ~text(parts(start_url)["path"]).rlike(LOGIN_PATH)
    return F.when(title.rlike(CHALLENGE_TITLE), "access-challenge").when(login, "login-required").when(title.rlike(ERROR_TITLE), "error-page")


def issue_category(url: Column, reason: Column) -> Column:
    """One of nine categories; the first rule that holds."""
    return let(parts(url), lambda p: issue_category_of(p, reason))


def issue_category_of(p: Column, reason: Column) -> Column:
    """``issue_category`` of a URL's parts."""
    login = boundary_of(p) | account_of(p) | text(p["path"]).rlike(LOGIN_ISSUE_PATH) | text(reason).contains("ログイン")
    says = text(reason)
    return (
        F.when(says.rlike(OUT_OF_SCOPE), "outOfScope").when(says.rlike(BROWSER_START), "browser").when(login, "login")
        .when(says.rlike(NOT_FOUND_REASON), "originMissing").when(says.rlike(REFUSED_REASON), "refused").when(says.rlike(TIMEOUT_REASON), "timeout")
        .when(says.rlike(NETWORK_REASON), "network").when(says.rlike(UNAVAILABLE_REASON), "unavailable").otherwise("other")
    )


def retryable_status(status: Column) -> Column:
    return F.coalesce(status.isin(408, 425, 429) | (status >= 500), F.lit(False))


def retryable_error(code: Column, message: Column) -> Column:
    says = text(message).rlike(RETRYABLE_MESSAGE)
    return F.when(F.coalesce(code == "NON_HTML_DOCUMENT", F.lit(False)), False).otherwise(F.coalesce(code.isin(RETRYABLE_CODES), F.lit(False)) | says)


def is_hls(mime: Column, url: Column) -> Column:
    return text(mime).rlike("(?i)mpegurl") | text(url).rlike(r"(?i)\.m3u8(?:[?#]|$)")


def is_dash(mime: Column, url: Column) -> Column:
    return text(mime).rlike(r"(?i)dash\+xml") | text(url).rlike(r"(?i)\.mpd(?:[?#]|$)")


def is_media_file(kind: Column, mime: Column, url: Column) -> Column:
    return ~is_hls(mime, url) & ~is_dash(mime, url) & ((text(kind) == "Media") | text(mime).rlike("(?i)^(?:video|audio)/"))


def needs_full_media(kind: Column, mime: Column, url: Column, status: Column, content_range: Column, declared: Column, size: Column) -> Column:
    """Media of which only a part came."""
    size, declared = F.coalesce(size, F.lit(0)), F.coalesce(declared, F.lit(0))
    part = F.coalesce(status == 206, F.lit(False)) | (text(content_range) != "") | (size == 0) | ((declared > 0) & (size < declared))
    return is_media_file(kind, mime, url) & text(url).rlike("(?i)^https?:") & part


def byte_range(value: Column, size: Column) -> Column:
    """struct<start, end, unsatisfiable> of a Range header; null if it isn't one."""
    first, last = (F.nullif(F.regexp_extract(text(value), r"(?i)^bytes=(\d*)-(\d*)$", i), F.lit("")).cast("long") for i in (1, 2))
    start = F.coalesce(first, F.greatest(F.lit(0), size - last))
    end = F.when(first.isNotNull() & last.isNotNull(), last).otherwise(size - 1)
    bad = (size == 0) | (first.isNull() & (last == 0)) | (start >= size) | (end < start)
    out = F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(True).alias("unsatisfiable")))
    return F.when(first.isNotNull() | last.isNotNull(), out.otherwise(F.struct(start.alias("start"), F.least(end, size - 1).alias("end"), F.lit(False).alias("unsatisfiable"))))


def resource_category(mime: Column, url: Column, background: Column) -> Column:
    """media, image or background, font, system, page, data or other."""
    return let(F.struct(F.lower(text(mime)).alias("mime"), F.lower(text(parts(url)["path"])).alias("path"), background.alias("background")), lambda r: category_of(r["mime"], r["path"], r["background"]))


def category_of(mime: Column, path: Column, background: Column) -> Column:
    """``resource_category`` of a type and a URL's path, both in lower case and not null."""
    return (
        F.when(mime.rlike(MEDIA_TYPE) | path.rlike(MEDIA_PATH), "media").when(mime.rlike(IMAGE_TYPE) | path.rlike(IMAGE_PATH), F.when(background, "background").otherwise("image"))
        .when(mime.rlike(FONT_TYPE) | path.rlike(FONT_PATH), "font").when(mime.rlike(SYSTEM_TYPE) | path.rlike(SYSTEM_PATH), "system")
        .when(mime.rlike(PAGE_TYPE), "page").when(mime.rlike(DATA_TYPE), "data").otherwise("other")
    )


def pressure(cpu: Column, memory: Column, disk: Column, network: Column, gpu: Column) -> Column:
    """normal, elevated, high or critical; a null metric says nothing."""
    at = lambda c, n: F.coalesce(c >= n, F.lit(False))
    return (
        F.when(at(cpu, 90) | at(memory, 92) | at(disk, 97), "critical")
        .when(at(cpu, 78) | at(memory, 86) | at(disk, 90) | at(network, 95) | at(gpu, 95), "high")
        .when(at(cpu, 65) | at(memory, 80) | at(disk, 75) | at(network, 85) | at(gpu, 85), "elevated").otherwise("normal")
    )


def adapted_limit(level: Column, base: int) -> Column:
    divided = lambda d: F.greatest(F.lit(1), F.ceil(F.lit(base) / d)).cast("int")
    return F.when(level == "critical", 1).when(level == "high", divided(3.0)).when(level == "elevated", divided(1.5)).otherwise(base)


def balanced_concurrency(pending: Column, limit: Column) -> Column:
    """Workers such that all waves are about as large."""
    cap, total = F.greatest(F.lit(1), limit), F.greatest(F.lit(0), pending)
    return F.when(total <= cap, cap).otherwise(F.greatest(F.lit(1), F.ceil(total / F.ceil(total / cap)))).cast("int")


def replay_page_status(page: dict[str, Column]) -> Column:
    """error, warning or healthy from the counters of a replayed page; missing counters are 0."""
    n = lambda k: F.coalesce(page[k].cast("double"), F.lit(0.0)) if k in page else F.lit(0.0)
    major = (n("navigation_error") > 0) | (n("document_status") >= 500) | (n("broken_images") > 0) | (n("media_errors") > 0) | ((n("text_length") == 0) & (n("loaded_images") == 0))
    minor = reduce(lambda a, b: a | b, [n(k) > 0 for k in ("missing_resources", "failed_requests", "runtime_errors", "interaction_errors", "interaction_skipped", "interaction_limit", "pending_images", "fonts_loading", "unreachable_containers", "not_at_bottom")])
    return F.when(major, "error").when(minor, "warning").otherwise("healthy")


def is_runtime_advisory(message: Column) -> Column:
    return text(message).rlike(ADVISORY_MESSAGE)


def is_isolation_message(message: Column) -> Column:
    return text(message).rlike(ISOLATION_MESSAGE)


def is_isolation_failure(blocked: Column, cors: Column, kind: Column, error: Column) -> Column:
    return (text(blocked) != "") | (text(cors) != "") | text(kind).isin("Ping", "WebSocket") | text(error).rlike(ISOLATION_ERROR)


def clamp_percent(value: Column) -> Column:
    # least and greatest skip nulls, so a null metric has to be kept apart
    return F.when(value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor(value.cast("double") * 10 + 0.5) / 10)))


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def reached(value: Column, limit: Column) -> Column:
    """A null limit is never reached."""
    return F.coalesce(value >= limit, F.lit(False))

import random

import pytest
from pyspark.sql import functions as F

from webstrata.functions import rules, text, urls
from webstrata.operators.pages import _middles, line_operations, srcset_urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "base", "expected"),
    [
        ("HttpS://News.Harbour.TEST:443/x/y/.././z?k=v#end", None, "https://news.harbour.test/x/z?k=v"),
        ("http://harbour.test:80/%7Ea/./", None, "http://harbour.test/%7Ea/"),
        ("http://harbour.test:8080", None, "http://harbour.test:8080/"),
        ("https://harbour.test/a(b)/c;d=1?e=[f]#g", None, "https://harbour.test/a(b)/c;d=1?e=[f]"),
        ("https://harbour.test/a/.hidden/..", None, "https://harbour.test/a/"),
        ("../../styles/main.css", "https://harbour.test/guide/part/one/", "https://harbour.test/guide/styles/main.css"),
        ("ftp://harbour.test/file", None, None),
        ("http://me@harbour.test/", None, None),
        ("//cdn.example/x", "https://example.com/", "https://cdn.example/x"),
        ("?a=1", "https://example.com/p?b=2", "https://example.com/p?a=1"),
        ("/é x", "https://example.com/", "https://example.com/%C3%A9%20x"),
        ("", "https://example.com/p#f", "https://example.com/p"),
        (None, "https://example.com/", None),
    ],
)
def test_normalize_url(spark, url, base, expected):
    assert one(spark, urls.normalize_url(F.lit(url).cast("string"), F.lit(base) if base else None)) == expected


def test_scope_and_depth(spark):
    domains = {"a.b.harbour.test": "harbour.test", "www.x.co.id": "x.co.id", "lab.dept.x.edu.au": "x.edu.au", "co.uk": "co.uk", "me.github.io": "me.github.io", "b.s3.amazonaws.com": "b.s3.amazonaws.com", "deep.b.s3.amazonaws.com": "b.s3.amazonaws.com", "10.0.0.1": "10.0.0.1", "localhost": "localhost"}
    assert {h: one(spark, urls.registrable_domain(F.lit(h))) for h in domains} == domains
    scope = lambda a, b: one(spark, urls.classify_scope(F.lit(a), F.lit(b), F.array(F.lit("kkvv"))))
    assert scope("https://www.example.com/", "https://docs.example.com/") == "site"
    assert scope("https://www.example.com/", "https://example.net/") == "external"
    assert scope("https://kkvv.example.com/", "https://a-kkvv.other.net/") == "keyword-site"
    assert one(spark, urls.normalize_keywords(F.lit("KKVV, kkvv, example-brand www 12345"))) == ["kkvv", "example-brand"]
    chain = [one(spark, urls.next_external_depth(F.lit(a), F.lit(b), F.lit(d))) for a, b, d in (("external", "site", 0), ("external", "external", 1), ("site", "external", 2))]
    assert chain == [1, 2, 0]


@pytest.mark.parametrize("ip,public", [("10.0.0.1", False), ("127.0.0.1", False), ("172.20.1.1", False), ("192.168.1.1", False), ("::1", False), ("fd00::1", False), ("::ffff:10.0.0.1", False), ("999.1.1.1", False), ("8.8.8.8", True), ("2606:4700::1111", True), ("::ffff:8.8.8.8", True)])
def test_public_ip(spark, ip, public):
    assert one(spark, urls.is_public_ip(F.lit(ip))) is public


def test_keys(spark):
    assert one(spark, urls.stable_document_key(F.lit("https://harbour.test/boats?NONCE=4&sort=age&x=eyJ0123456789.0123456789.0123456789"))) == "https://harbour.test/boats?sort=age"
    assert one(spark, urls.apply_query_policy(F.lit("https://harbour.test/boats?gclid=4&sort=age&utm_term=z#top"), "drop-tracking")) == "https://harbour.test/boats?sort=age#top"
    safe = urls.safe_url(F.lit("https://example.com/a/b/c.png?mail=a@b.c&width=3"), "k")
    assert one(spark, safe).startswith("https://example.com/[segments:3;ext:.png]?keys=[redacted-key],width#id=")
    assert one(spark, urls.safe_url(safe, "k")) == one(spark, safe)
    assert one(spark, urls.page_seed(F.lit("a"))) == 0xE40C292C


def test_html_text(spark):
    html = "<head><title>Boats</title></head><script src=x>if (a < b) c()</script><ul><li>One&nbsp;mast<li>Two &lt;masts&gt; &#x2693;</ul><noscript>off</noscript><!-- <p>note</p> -->"
    assert one(spark, text.html_to_search_text(F.lit(html))) == "Boats One mast Two <masts> ⚓"
    assert one(spark, text.html_to_lines(F.lit("<div>Sail<br>Oar &amp; rudder</div><template>no</template><table><tr><td>a</td><td>b</td></tr></table>"))) == ["Sail", "Oar & rudder", "a b"]
    assert one(spark, text.html_to_search_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.decode_entities(F.lit("&bogus; &#128512; &lt;"))) == "&bogus; 😀 <"


def plain_operations(a, b):
    """The rule by a table of common lengths, for short lists."""
    common = lambda i, j: 0 if i == len(a) or j == len(b) else 1 + common(i + 1, j + 1) if a[i] == b[j] else max(common(i + 1, j), common(i, j + 1))
    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and common(i + 1, j) >= common(i, j + 1):
            out.append(("remove", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out


def test_line_operations():
    rng = random.Random(5)
    for _ in range(300):
        head, tail = ["h"] * rng.randrange(2), ["t"] * rng.randrange(2)
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(7))] for _ in range(2))
        ops = line_operations(head + a + tail, head + b + tail)
        assert [x for k, x in ops if k != "add"] == head + a + tail and [x for k, x in ops if k != "remove"] == head + b + tail
        n, x, y = _middles(head + a + tail, head + b + tail)
        rest = (head + a + tail)[n + len(x) :]
        assert ops == [("same", v) for v in (head + a + tail)[:n]] + plain_operations(x, y) + [("same", v) for v in rest]
    assert line_operations(["p", "q", "r"], ["s", "q2", "r"], limit=1) == [("remove", "p"), ("remove", "q"), ("add", "s"), ("add", "q2"), ("same", "r")]
    assert line_operations([], []) == [] and line_operations(["p"], []) == [("remove", "p")]
    long = [str(k % 700) for k in range(3000)]
    assert sum(k == "same" for k, _ in line_operations(long, long[::-1])) > 5


def test_media_and_charset(spark):
    hls = one(spark, text.hls_targets(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:X\nlow.m3u8\ns1.ts\n"), F.lit("https://m.example/v/i.m3u8")))
    assert (hls.playlists, hls.segments) == (["https://m.example/v/low.m3u8"], ["https://m.example/v/s1.ts"])
    assert one(spark, text.iso_duration_seconds(F.lit("P1DT2H3M4.5S"))) == 86400 + 7200 + 180 + 4.5
    assert one(spark, text.fill_template(F.lit("$RepresentationID$/$Number%05d$.m4s$$"), {"RepresentationID": F.lit("v1"), "Number": F.lit(42)})) == "v1/00042.m4s$"
    assert one(spark, text.detect_charset(F.lit("text/html; charset=Shift_JIS"), F.lit(b"\xef\xbb\xbfx"))) == "utf-8"
    assert one(spark, text.detect_charset(F.lit("text/css"), F.lit(b'@charset "euc-jp";'))) == "euc-jp"
    assert one(spark, srcset_urls(F.lit("a.png 1x, b.png 2x"))) == ["a.png", "b.png"]


def test_rules(spark):
    page = lambda **k: one(spark, rules.classify_page(*[F.lit(k.get(n)).cast("string") for n in ("start", "asked", "url", "title", "html")], F.lit(k.get("status"))))
    assert page(url="https://a.example/", title="Just a moment...", html="<p>x</p>").classification == "access-challenge"
    assert page(asked="https://a.example/x", url="https://a.example/login", title="x", html="<p>x</p>").classification == "login-required"
    assert page(url="https://a.example/", title="x", html="<p>x</p>", status=404).level == "failed"
    assert page(url="https://a.example/", title="x", html=None).classification == "missing-html"
    assert page(url="https://a.example/", title="x", html="<p>x</p>").score == 100
    r = one(spark, rules.byte_range(F.lit("bytes=-5"), F.lit(100).cast("long")))
    assert (r.start, r.end) == (95, 99)
    assert one(spark, rules.byte_range(F.lit("bytes=200-"), F.lit(100).cast("long"))).unsatisfiable
    assert [one(spark, rules.balanced_concurrency(F.lit(a), F.lit(b))) for a, b in ((61, 30), (5, 30))] == [21, 30]

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webstrata.operators import archives as A
from webstrata.operators import graph as G
from webstrata.operators import pages as P
from webstrata.operators import requests as R
from webstrata.operators import services as S
from webstrata.sources import logs, packages
from webstrata.sources.warc import WarcSource, cdxj


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_shared_pages_removed_last_put_does_not_return(spark):
    log = spark.createDataFrame([(1, "u", "a", None, None), (2, "u", "b", None, None), (3, None, None, None, "b"), (4, "v", "b", None, None), (5, "w", "a", "p", None)], "line_no long, url string, archive_id string, page_url string, remove_archive string")
    live = spark.createDataFrame([("a",), ("b",)], "archive_id string")
    assert rows(A.shared_pages(log, live), "url") == [("w", "a", "p")]


def test_search_log_keeps_first_place(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"url":"/a","title":"A","text":"1"}\nbroken\n{"url":"/b","title":"B \\"q\\"","text":"2"}\n{"url":"/a","title":"A v2","text":"3"}\n')
    out = logs.read_search_index(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.url, r.title) for r in out] == [("/a", "A v2"), ("/b", 'B "q"')]


def test_search(spark):
    docs = spark.createDataFrame([(1, "u1", "見本", "アクリル 板"), (2, "u2", None, "アクリル 配送")], "rank int, url string, title string, text string")
    assert [r.total for r in P.search(docs, "アクリル").collect()] == [2, 2]
    assert [r.url for r in P.search(docs, "アクリル 配送").collect()] == ["u2"]
    assert P.search(docs, "  ").count() == 0


def test_issue_report_and_empty(spark):
    blocked = spark.createDataFrame([(1, 0, "https://a.example/x", "HTTP 404"), (1, 1, "https://a.example/x", "HTTP 404"), (1, 2, "https://a.example/login/", None), (1, 3, "https://a.example/y", "取得深度上限")], "archive_id int, ordinal int, url string, reason string")
    pages = spark.createDataFrame([], "archive_id int, ordinal int, url string, classification string, reason string")
    out = A.issue_report(blocked, blocked.filter("false"), pages)
    assert rows(out.select("category", "n"), "category") == [("login", 1), ("originMissing", 1), ("outOfScope", 1)]
    assert A.issue_report(blocked.filter("false"), blocked.filter("false"), pages).count() == 0


def test_cleanup_protects_newest_of_host(spark):
    t = lambda n: datetime(2024, 1, n)
    a = spark.createDataFrame([(1, "https://a.example/", t(1), 10), (2, "https://a.example/", t(2), 10), (3, "bad", t(3), 10), (4, "https://b.example/", t(1), 10)], "archive_id int, start_url string, saved_at timestamp, freeable long")
    assert [r[0] for r in rows(A.cleanup_plan(a, 100, 85).select("archive_id", "saved_at"), "saved_at")] == [1, 3]
    assert [r[0] for r in rows(A.cleanup_plan(a, 100, 95).select("archive_id", "saved_at"), "saved_at")] == [1]


def test_crawl_cycle_and_scope(spark):
    links = spark.createDataFrame([("https://a.example.com/", "https://b.example.com/"), ("https://b.example.com/", "https://a.example.com/"), ("https://b.example.com/", "https://x.other.net/"), ("https://x.other.net/", "https://y.third.net/"), ("https://y.third.net/", "https://a.example.com/")], "src string, dst string")
    seeds = spark.createDataFrame([("https://a.example.com/",)], "url string")
    out = G.crawl_frontier(seeds, links, max_external=1)
    assert rows(out.select("url", "depth", "external_depth"), "depth") == [("https://a.example.com/", 0, 0), ("https://b.example.com/", 1, 0), ("https://x.other.net/", 2, 1)]
    assert G.crawl_frontier(seeds.filter("false"), links).count() == 0


def test_page_found_again_with_a_smaller_external_depth_is_opened_again(spark):
    """Over the short way the page lies two outside, over the long way one: only then its link still fits the limit."""
    a, x = (lambda n: f"https://a.example/{n}"), (lambda n: f"https://{n}.test/")
    links = [(a(0), x("x1")), (x("x1"), x("p")), (a(0), a(1)), (a(1), a(2)), (a(2), x("p")), (x("p"), x("q")), (x("q"), x("r")), (x("q"), a(0))]
    out = G.crawl_frontier(spark.createDataFrame([(a(0),)], "url string"), spark.createDataFrame(links, "src string, dst string"), max_external=2)
    assert rows(out.select("url", "depth", "external_depth"), "url") == [(a(0), 0, 0), (a(1), 1, 0), (a(2), 2, 0), (x("p"), 2, 1), (x("q"), 4, 2), (x("x1"), 1, 1)]
    assert {r.url: r.parent for r in out.collect()}[x("p")] == x("x1")


def test_long_redirect_chains_are_no_loops(spark):
    edges = spark.range(400).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    out = G.redirect_chains(edges, 50)
    assert {r.state: r["count"] for r in out.groupBy("state").count().collect()} == {"ok": 50, "too-long": 350}


SUFFIX_LIST = """// ===BEGIN ICANN DOMAINS===
com
ck
*.ck
!www.ck
uk
co.uk  // with a remark
*.kawasaki.jp
!city.kawasaki.jp
jp

// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
*.compute.example.com
// ===END PRIVATE DOMAINS===
"""


def test_suffix_rules_of_a_list(spark, tmp_path):
    from webstrata.operators import suffixes

    (tmp_path / "list.dat").write_text(SUFFIX_LIST)
    rules = suffixes.read_rules(spark, f"file://{tmp_path}/list.dat")
    assert {r.rule: r.section for r in rules.collect()}["*.compute.example.com"] == "private" and rules.count() == 11
    want = {
        "a.b.com": ("com", "icann", "b.com"), "B.Com.": ("com", "icann", "b.com"), "com": ("com", "icann", "com"), "x.y.z.co.uk": ("co.uk", "icann", "z.co.uk"), "co.uk": ("co.uk", "icann", "co.uk"),
        "a.b.c.ck": ("c.ck", "icann", "b.c.ck"), "c.ck": ("c.ck", "icann", "c.ck"), "ck": ("ck", "icann", "ck"), "www.ck": ("ck", "icann", "www.ck"), "a.www.ck": ("ck", "icann", "www.ck"),
        "x.y.kawasaki.jp": ("y.kawasaki.jp", "icann", "x.y.kawasaki.jp"), "x.city.kawasaki.jp": ("kawasaki.jp", "icann", "city.kawasaki.jp"), "u.github.io": ("github.io", "private", "u.github.io"), "a.u.github.io": ("github.io", "private", "u.github.io"),
        "h.r.compute.example.com": ("r.compute.example.com", "private", "h.r.compute.example.com"), "compute.example.com": ("com", "icann", "example.com"), "a.b.unknown": ("unknown", None, "b.unknown"), "local": ("local", None, "local"),
        "10.0.0.1": (None, None, "10.0.0.1"), "[::1]": (None, None, "::1"), "": ("", None, ""),
    }
    hosts = spark.createDataFrame([(h,) for h in [*want, None, "a.b.com"]], "host string")
    assert {r.host: (r.suffix, r.section, r.domain) for r in suffixes.registrable(hosts, rules).collect()} == want
    assert suffixes.registrable(hosts.filter("false"), rules).count() == 0 and suffixes.registrable(hosts, rules.filter("false")).filter("host = 'x.y.z.co.uk'").first().domain == "co.uk"


def test_join_and_column_agree_on_the_listed_rules(spark):
    from webstrata.functions import urls
    from webstrata.operators import suffixes
    from webstrata.plans.queries import ENDS

    hosts = spark.createDataFrame([(f"{p}{e}",) for e in [*ENDS, "org.de", "a.co.nz", "b.gov.xx", "x.y.bd"] for p in ("", "m.", "a.b.")], "host string").filter("host not like '%.192.0.2.7'")
    joined = suffixes.registrable(hosts, suffixes.own_rules(spark)).withColumn("column", urls.registrable_domain(F.col("host")))
    assert joined.filter("not domain <=> column").collect() == []


def test_redirect_chains(spark):
    out = G.redirect_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string"))
    assert rows(out, "url") == [("a", "c", 2, "ok"), ("b", "c", 1, "ok"), ("x", None, None, "loop"), ("y", None, None, "loop")]


def test_leaves_and_similar_posts(spark):
    bodies = spark.createDataFrame([(1, '{"videoId":"x","nested":{"list":[1,2]}}'), (2, "a=1&b=c%20d"), (3, None), (4, "[]"), (5, "plain text")], "id int, body string")
    assert rows(R.body_leaves(bodies), "id", "path") == [(1, "nested.list.0", "1"), (1, "nested.list.1", "2"), (1, "videoId", "x"), (2, "a", "1"), (2, "b", "c d"), (4, "", "[]")]
    asked = spark.createDataFrame([(1, 1, "https://h.example/q", "p")], "id int, archive_id int, url string, page_url string")
    saved = spark.createDataFrame([(1, 1, 10, "https://h.example/q", "p"), (1, 2, 11, "https://h.example/q", "p")], "archive_id int, ordinal int, response int, url string, page_url string")
    ours = spark.createDataFrame([(1, "id", "7"), (1, "n", "1")], "id int, path string, value string")
    theirs = spark.createDataFrame([(10, "id", "8"), (10, "n", "1"), (11, "id", "7"), (11, "n", "2")], "response int, path string, value string")
    assert rows(R.similar_posts(asked, ours, saved, theirs), "id") == [(1, 11, 1.0)]
    mute = spark.createDataFrame([(2, 1, "https://h.example/q?x=1", "p"), (3, 2, "https://h.example/q?x=1", "p"), (4, 2, "https://h.example/q", "p")], "id int, archive_id int, url string, page_url string")
    more = saved.union(spark.createDataFrame([(2, 1, 12, "https://h.example/q", "p")], saved.schema))
    assert rows(R.similar_posts(mute, ours.filter("false"), more, theirs), "id") == [(3, 12, None)]  # of several, or of a known URL, none
    deep = spark.createDataFrame([(1, '{"a":' * 11 + "7" + "}" * 11)], "id int, body string")
    assert rows(R.body_leaves(deep), "id") == [(1, ".".join("a" * 11), "7")]


def test_schedule(spark):
    at = F.lit(datetime(2026, 1, 7, 10, 30))  # a Wednesday
    nxt = lambda f, h, m, w: spark.range(1).select(S.next_run(F.lit(f), F.lit(h), F.lit(m), F.lit(w), at)).first()[0]
    assert nxt("hourly", 0, 30, 0) == datetime(2026, 1, 7, 11, 30)
    assert nxt("daily", 9, 0, 0) == datetime(2026, 1, 8, 9, 0)
    assert nxt("weekly", 9, 0, 3) == datetime(2026, 1, 14, 9, 0)
    assert nxt("weekly", 11, 0, 3) == datetime(2026, 1, 7, 11, 0)


def test_tuner_and_watch(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    e = spark.createDataFrame([("capture", t(x)) for x in (0, 2, 5, 6, 11)], "kind string, ts timestamp")
    assert [r[2] for r in rows(S.tuner_reductions(e, 30), "ts")] == [30, 29, 28]
    w = spark.createDataFrame([("w", t(1), "価格 1,000円"), ("w", t(2), " 価格  1,000円"), ("w", t(3), "価格 900円"), ("w", t(4), None)], "watch_id string, ts timestamp, text string")
    assert [r[0] for r in rows(S.watch_changes(w).select("changed", "ts"), "ts")] == [False, False, True, True]


def test_warc_round_trip(spark, tmp_path):
    spark.dataSource.register(WarcSource)
    df = spark.createDataFrame([("https://a.example/x", 200, {"Content-Encoding": "gzip", "X": "1"}, bytearray(b"hello"), datetime(2024, 1, 1)), ("https://a.example/y", 404, None, None, None)], "url string, status int, headers map<string,string>, body binary, captured_at timestamp")
    df.coalesce(1).write.format("warc").mode("append").save(str(tmp_path))
    back = spark.read.format("warc").load(str(tmp_path)).filter("type = 'response'").orderBy("url").collect()
    assert [r.url for r in back] == ["https://a.example/x", "https://a.example/y"]
    assert bytes(back[0].block) == b"HTTP/1.1 200 OK\r\nX: 1\r\ncontent-length: 5\r\n\r\nhello"
    lines = cdxj(df.select("url", "captured_at", F.lit("text/html").alias("mime_type"), "status", F.lit("d").alias("digest"), F.lit("f").alias("file"), F.lit(0).alias("offset")))
    assert lines.first().line.startswith("example,a)/x 20240101000000 {")


def test_warc_members_stream_in_parts():
    import io

    from webstrata.sources.warc import read_members, warc_record

    bodies = [b"x" * n for n in (0, 10, 5000, 3)]
    data = b"".join(warc_record("response", {"WARC-Target-URI": str(len(b))}, b) for b in bodies)
    for size in (1, 7, 1 << 20):
        found = list(read_members(io.BytesIO(data), size))
        assert [b for _, _, b in found] == bodies and [int(h["warc-target-uri"]) for _, h, _ in found] == [len(b) for b in bodies]
        assert found[0][0] == 0 and all(data[at : at + 2] == b"\x1f\x8b" for at, _, _ in found)
    with pytest.raises(ValueError):
        list(read_members(io.BytesIO(data[:-5])))


def test_blobs(spark, tmp_path):
    bodies = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"a")), (3, bytearray(b"b")), (4, bytearray(b""))], "id int, body binary")
    folder = str(tmp_path / "blobs")
    logs.store_blobs(bodies, folder)
    logs.store_blobs(bodies, folder)
    assert spark.read.parquet(folder).count() == 3
    digest = hashlib.sha256(b"c").hexdigest()
    spark.createDataFrame([(digest, bytearray(b"broken"), digest[:2])], "digest string, body binary, prefix string").write.mode("append").partitionBy("prefix").parquet(folder)
    assert logs.read_blobs(spark, folder).count() == 3  # the damaged body doesn't count
    logs.store_blobs(spark.createDataFrame([(5, bytearray(b"c"))], "id int, body binary"), folder)
    assert sorted(bytes(r.body) for r in logs.read_blobs(spark, folder).collect()) == [b"", b"a", b"b", b"c"]
    f = spark.createDataFrame([("/x/ab/" + "ab" + "0" * 62,), ("/x/ac/" + "ab" + "0" * 62,), ("/x/ab/readme",)], "path string")
    assert logs.valid_blobs(f).count() == 1


def test_packages(spark, tmp_path):
    import tarfile

    files = spark.createDataFrame([(1, 1, "manifest.json", bytearray(b"{}")), (1, 2, "blobs/aa", bytearray(b"x" * 3000)), (2, 1, "manifest.json", None)], "archive_id long, place long, name string, content binary")
    out = packages.write_packages(files, folder=f"file://{tmp_path}/tar")
    back = sorted((r.archive_id, r.place, r.name, bytes(r.content)) for r in packages.read_tars(out).collect())
    assert back == [(1, 0, "manifest.json", b"{}"), (1, 1, "blobs/aa", b"x" * 3000), (2, 0, "manifest.json", b"")]
    assert packages.listed(spark, f"file://{tmp_path}/tar").count() == 2 and packages.write_packages(files.filter("false")).count() == 0
    (tmp_path / "bad").mkdir()
    with tarfile.open(tmp_path / "bad" / "9-x.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo("../out"))
    with pytest.raises(Exception, match="unsafe name"):
        packages.read_tars(packages.listed(spark, f"file://{tmp_path}/bad")).collect()


WACZ_RECORDS = "archive_id long, url string, captured_at timestamp, status int, headers map<string,string>, mime_type string, body binary"


def wacz_tables(spark):
    from datetime import datetime

    at = datetime(2024, 5, 6, 7, 8, 9)
    records = [(a, f"https://www.b.example/{'é' if i == 5 else i}?z=1&a=2", None if i == 3 else at, None if i == 4 else 200, {"Set": "x", "Content-Encoding": "gzip"} if i % 2 else None, "text/html; charset=x", None if i == 6 else bytearray(f"body {a} {i} ".encode() * (1 + 997 * i))) for a in (1, 2) for i in range(30)]
    records += [(1, "https://b.example/0?a=2&z=1", at, 404, None, None, bytearray(b"same key")), (9, "https://b.example/", at, 200, None, "x", bytearray(b"not listed"))]
    pages = spark.createDataFrame([(1, "https://b.example/", at, "One"), (1, "https://b.example/2", None, None), (2, "not a url", at, 'Tw"o')], "archive_id long, url string, captured_at timestamp, title string")
    archives = spark.createDataFrame([(1, "T", "https://b.example/", at), (2, None, "https://c.example/", None), (3, None, None, None)], "archive_id long, title string, start_url string, main_date timestamp")
    return archives, spark.createDataFrame(records, WACZ_RECORDS), pages, records


@pytest.mark.parametrize("most", [1 << 30, 100_000])
def test_wacz_is_read_back_through_its_index(spark, tmp_path, most):
    import gzip
    import json
    import zipfile

    from webstrata.sources import wacz

    archives, records, pages, data = wacz_tables(spark)
    out = wacz.write_wacz(archives, records, pages, folder=f"file://{tmp_path}/w", most_bytes=most)
    made = out.collect()
    assert {r.archive_id for r in made} == {1, 2, 3} and sum(r.records for r in made) == 61 and sum(r.pages for r in made) == 3
    assert (len(made) == 3) == (most > 1 << 20)
    index = wacz.read_index(out)
    back = wacz.fetch(index).collect()
    plain = lambda b: bytes(b or b"")
    assert sorted((r.archive_id, r.url, r.status, bytes(r.body)) for r in back) == sorted((a, u, s or 200, plain(b)) for a, u, _, s, _, _, b in data if a < 9)
    assert all("Content-Encoding" not in r.headers and r.headers.startswith(f"HTTP/1.1 {r.status}") and f"content-length: {len(r.body)}" in r.headers for r in back)
    for r in made:  # an entry of gzip members, an index that is sorted, lists with their heads
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.namelist() == [wacz.DATA, wacz.INDEX, wacz.PAGES, "datapackage.json"]
            raw, about = z.read(wacz.DATA), json.loads(z.read("datapackage.json"))
            lines = z.read(wacz.INDEX).decode().splitlines()
            keys = [line.split(" ", 2)[:2] for line in lines]
            assert keys == sorted(keys)
            for line in lines:
                e = json.loads(line.split(" ", 2)[2])
                member = raw[int(e["offset"]) : int(e["offset"]) + int(e["length"])]
                assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response") and e["url"].encode() in gzip.decompress(member)
            first, *listed = z.read(wacz.PAGES).decode().splitlines()
            assert json.loads(first)["format"] == "json-pages-1.0" and all({"id", "url", "ts", "title"} <= set(json.loads(x)) for x in listed)
            assert {x["path"] for x in about["resources"]} == {wacz.DATA, wacz.INDEX, wacz.PAGES} and about["mainPageDate"]
    assert {r.entry for r in wacz.verified(out).collect() if r.whole} == {wacz.DATA, wacz.INDEX, wacz.PAGES} and wacz.verified(out).filter("not whole").count() == 0
    assert wacz.write_wacz(archives.filter("false"), records, pages).count() == 0


def test_wacz_reads_only_the_members_asked_for(spark, tmp_path):
    """Everything but one member and the directory is destroyed; that member is read all the same, others raise."""
    from webstrata.sources import wacz

    archives, records, pages, _ = wacz_tables(spark)
    out = wacz.write_wacz(archives.filter("archive_id = 1"), records, pages, folder=f"file://{tmp_path}/w")
    index = wacz.read_index(out).collect()
    one = next(r for r in index if r.url.endswith("/7?z=1&a=2"))
    path = one.path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    begin = 30 + int.from_bytes(data[26:28], "little") + int.from_bytes(data[28:30], "little")
    end = data.find(b"PK\x03\x04", begin + sum(r.length for r in index))
    kept = range(begin + one.offset, begin + one.offset + one.length)
    for i in range(begin, end):
        if i not in kept:
            data[i] = 0
    open(path, "wb").write(data)
    asked = spark.createDataFrame(index)
    got = wacz.fetch(asked.filter(F.col("url") == one.url)).collect()
    assert [bytes(r.body) for r in got] == [b"body 1 7 " * (1 + 997 * 7)]
    assert [r.entry for r in wacz.verified(out).collect() if not r.whole] == [wacz.DATA]
    with pytest.raises(Exception, match="not a"):
        wacz.fetch(asked.filter(F.col("url") != one.url)).collect()


def test_requests_are_linked_to_their_responses(spark, tmp_path):
    from webstrata.sources import warc

    assert warc.http_request("GET", "https://a.example?x=1#f", {"Host": "b", "A": "1"}, b"") == b"GET /?x=1 HTTP/1.1\r\nHost: a.example\r\nA: 1\r\n\r\n"
    assert warc.http_request("POST", "https://a.example/p?x=1", {}, b"ab") == b"POST /p?x=1 HTTP/1.1\r\nHost: a.example\r\ncontent-length: 2\r\n\r\nab"
    spark.dataSource.register(warc.WarcSource)
    rows_ = [("https://a.example/1", 200, None, bytearray(b"x"), "GET"), ("https://a.example/2", 200, {"A": "b"}, None, None)]
    df = spark.createDataFrame(rows_, "url string, status int, headers map<string,string>, body binary, request_method string").withColumn("captured_at", F.lit(None).cast("timestamp"))
    df.write.format("warc").mode("append").save(f"file://{tmp_path}/r")
    back = spark.read.format("warc").load(f"file://{tmp_path}/r").filter("type <> 'warcinfo'").collect()
    ids = {r.record_id: r for r in back}
    assert sorted((r.type, r.url) for r in back) == [("request", "https://a.example/1"), ("response", "https://a.example/1"), ("response", "https://a.example/2")]
    assert [ids[r.concurrent_to].url for r in back if r.type == "request"] == ["https://a.example/1"] and len(ids) == 3


def test_crawl_is_deeper_than_any_fixed_number_of_rounds(spark):
    links = spark.range(230).select(F.concat(F.lit("https://d.example/"), "id").alias("src"), F.concat(F.lit("https://d.example/"), F.col("id") + 1).alias("dst"))
    seeds = spark.createDataFrame([("https://d.example/222",)], "url string")
    assert G.crawl_frontier(seeds, links).agg(F.max("depth")).first()[0] == 8
    assert G.crawl_frontier(seeds, links, max_depth=3).count() == 4


def test_records(spark):
    from webstrata.operators import capture as M
    from webstrata.operators import records as C

    jobs = spark.createDataFrame([(1, "a", "complete", 1, 0), (2, "a", "paused", 2, 5), (3, "b", "failed", 1, 4)], "job_id int, archive_id string, status string, created_at int, waiting int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "archive_id string")
    assert rows(C.continue_archives(asked, jobs), "archive_id") == [("a", "ARCHIVE_BUSY", None), ("b", "resumed", 3), ("c", "NOT_FOUND", None)]
    old = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "id int, at int, text string")
    new = spark.createDataFrame([(2, 5, "z"), (3, 9, "late"), (4, 8, "early")], "id int, at int, text string")
    assert rows(C.upsert_records(old, new, "id", "at", 3).select("id", "text"), "id") == [(1, "x"), (2, "z"), (4, "early")]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    h = lambda i, u: tuple(one(M.append_history(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(i), F.lit(u).cast("string"))))
    assert h(0, "z") == (["a", "z"], 1) and h(1, "b") == (["a", "b", "c"], 1) and h(2, None) == (["a", "b", "c"], 2)
    assert one(M.resolve_asset(F.lit("data:x"), F.lit("https://a.example/"), F.lit(1))) == "data:x"
    assert one(M.rewrite_script(F.lit("import 'react'"), F.lit("https://a.example/"), F.lit(1))) == "import 'react'"


def test_alerts_and_tuner_stream_and_excluded_hosts_join(spark):
    import random

    from webstrata.operators import jobs as J

    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.randrange(400) * 1800) for _ in range(600)]
    errors = spark.createDataFrame(data, "kind string, s long").select("kind", F.timestamp_seconds("s").alias("ts"), F.lit(9).alias("used")).repartition(5)

    def fold(times, gap, most=10**9):
        out = []
        for t in sorted(times):
            if len(out) < most and (not out or t - out[-1] >= gap):
                out.append(t)
        return out

    alerts = J.alert_times(errors, 5)
    assert sorted(r.s for r in alerts.select(F.unix_seconds("ts").alias("s")).collect()) == fold([t for _, t in data], 86400)
    tuner = S.tuner_reductions(errors, 8, 7200)
    want = {(k, t, 8 - n, 7 - n) for k in ("a", "b", None) for n, t in enumerate(fold([t for x, t in data if x == k], 7200, 7))}
    assert {tuple(r) for r in tuner.select("kind", F.unix_seconds("ts"), "from", "to").collect()} == want
    for df in (alerts, tuner):
        assert "collect_list" not in df._jdf.queryExecution().toString()
    found = spark.createDataFrame([(i, f"https://m.h{i}.example/") for i in range(400)] + [(400, "https://h.example/")], "page_id long, url string")
    hosts = spark.createDataFrame([(f"m.h{i}.example",) for i in range(400)], "host string")
    assert [r.page_id for r in J.discovered_queue(found, hosts).collect()] == [400]


def test_line_changes_of_long_pages(spark):
    """pages with more than 3000 lines between equal ends had all of them removed and added."""
    lines = [f"line {k % 2900}" for k in range(8000)]
    moved = ["new one", *lines[:4000], "new two", *lines[4001:], "new three"]
    df = spark.createDataFrame([("k", "u", "changed", lines, moved), ("l", "v", "changed", lines + ["old"], ["new"] + lines), ("m", "w", "changed", lines, [])], "key string, url string, status string, lines_old array<string>, lines_now array<string>")
    assert [tuple(r) for r in P.line_changes(df).collect()] == [("m", "w", 0, 8000), ("k", "u", 3, 1), ("l", "v", 1, 1)]


def test_lengths_of_common_lines():
    """the count without the integers of earlier lines against the one with them."""
    import random

    from webstrata.operators.pages import _common_from, _common_length

    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcdefg"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert _common_length(a, b) == _common_from(a, b)[0].bit_count()
    # lines without a place of their own size too
    a = [str(rng.randrange(4000)) for _ in range(3000)]
    b = [x for x in a if rng.random() < 0.9] + [str(rng.randrange(4000)) for _ in range(500)]
    b = [*b[:100], *rng.sample(b[100:900], 800), *b[900:]]
    assert _common_length(a, b) == _common_length(b, a) == _common_from(a, b)[0].bit_count()

"""Repeated URLs, aliases and bodies, tables larger than the driver's smallest, and work that is done once for each class of rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from webstrata import catalog
from webstrata.functions import urls
from webstrata.operators import archives as A
from webstrata.operators import capture as M
from webstrata.operators import jobs as J
from webstrata.operators import pages as P
from webstrata.operators import requests as R
from webstrata.sources import logs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def equals_sql(spark, folder, name, **tables):
    import duckdb

    db = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_replaced_pages_of_a_url_captured_twice(spark, tmp_path):
    old = spark.createDataFrame([("u", 1, False, "a"), ("u", 2, False, "b"), ("v", 3, True, "c")], "url string, n int, partial boolean, html string")
    new = spark.createDataFrame([("u", 1, False, "A"), ("u", 2, True, "B"), ("w", 4, True, "D")], old.schema)
    assert rows(J.replace_pages(old, new, "n").select("url", "n", "html"), "n") == [("u", 1, "A"), ("u", 2, "b"), ("v", 3, "c"), ("w", 4, "D")]
    equals_sql(spark, tmp_path, "DML9_replace_pages", pages=spark.createDataFrame([(1, "u", "x"), (2, "u", "y"), (3, "v", "z")], "page_id long, url string, html string"))


def test_similar_posts_looks_at_all_candidates(spark):
    asked = spark.createDataFrame([(1, 1, "https://h.example/q", "p"), (2, 1, "https://h.example/q", "p"), (3, 1, "https://h.example/q", None)], "id int, archive_id int, url string, page_url string")
    saved = spark.range(500).selectExpr("1 archive_id", "id ordinal", "id response", "'https://h.example/q' url", "if(id = 9, 'p', 'q') page_url")
    ours = spark.createDataFrame([(1, "n", "1"), (2, "n", "1"), (3, "n", "1")], "id int, path string, value string")
    theirs = saved.selectExpr("response", "'n' path", "if(response in (5, 7, 9), '1', '2') value")
    assert rows(R.similar_posts(asked, ours, saved, theirs, candidates=None), "id") == [(1, 9, 1.0), (2, 9, 1.0), (3, 5, 1.0)]
    assert rows(R.similar_posts(asked, ours, saved, theirs, candidates=492), "id") == [(1, 9, 1.0), (2, 9, 1.0), (3, 9, 1.0)]


def test_alias_with_several_targets(spark):
    refs = spark.createDataFrame([(1, "https://a.example/x"), (1, "https://a.example/y")], "archive_id int, ref string")
    known = spark.createDataFrame([(1, "https://a.example/k")], "archive_id int, url string")
    aliases = spark.createDataFrame([(1, "https://a.example/x", "https://a.example/k"), (1, "https://a.example/x", "https://a.example/gone"), (1, "https://a.example/y", "https://a.example/gone")], "archive_id int, alias string, target string")
    assert rows(P.reference_audit(refs, known, aliases), "ref") == [(1, "https://a.example/y", "missing")]


def events(spark, found):
    return spark.createDataFrame([(n, ts, user, kind, 1.0, "{}") for n, (ts, user, kind) in enumerate(found)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_references_of_any_archive(spark, tmp_path):
    at = datetime(2024, 1, 1)
    equals_sql(spark, tmp_path, "JN7_references_to", events=events(spark, [(at, u, "view") for u in (2, 60, 61, 1110, 1160, 70_010)]))


def test_page_list_takes_files_by_name(spark, tmp_path):
    line = '{"url":"/a","title":"%s"}\n'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.json").write_text(line % "old")
    (tmp_path / "log" / "part-1.json").write_text(line % "new" * 50)
    (tmp_path / "log" / "part-2.json").write_text(line % "last" * 2)
    assert [r.title for r in logs.page_list(spark, str(tmp_path / "log")).collect()] == ["last"]
    equals_sql(spark, tmp_path, "SRC4_SNK8_page_list", pages=spark.createDataFrame([(1, "https://u.example/", "x"), (2, "https://u.example/", "y"), (3, "https://v.example/#a", "z")], "page_id long, url string, html string"))


def test_schedule_up_to_the_watermark(spark, tmp_path):
    at, day = datetime(2024, 1, 1), timedelta(days=1)
    # user 1 is busy: its run five minutes before the end lies between two of its events, behind the watermark
    found = [(at, 1, "view"), (at + timedelta(hours=1), 1, "click"), (at + day + timedelta(minutes=15), 1, "view"), (at + timedelta(minutes=1), 2, "view"), (at + day + timedelta(minutes=15), 2, "view")]
    equals_sql(spark, tmp_path, "STM5_schedule_timers", events=events(spark, found).selectExpr("*"))


def test_peers_are_found_in_each_row(spark):
    found = [(n, n - 1 if n == 4 else n if n == 5 else None, "https://h.example/", datetime(2024, 1, 1 + n)) for n in range(1, 9)]
    out = A.peer_archives(spark.createDataFrame(found, "archive_id long, previous_archive_id long, start_url string, saved_at timestamp"), 3)
    assert rows(out.filter("archive_id in (4, 5, 8)"), "archive_id", "place") == [(4, 3, 1), (4, 8, 2), (4, 7, 3), (5, 8, 1), (5, 7, 2), (5, 6, 3), (8, 7, 1), (8, 6, 2), (8, 5, 3)]


def test_page_identity_compares_each_page_once(spark):
    asked = spark.createDataFrame([(n, 1, "https://h.example/q", f"https://p.example/watch?v=abcdef{n % 2}") for n in range(6)], "id int, archive_id int, url string, page_url string")
    saved = spark.createDataFrame([(1, n, 10 + n, "https://h.example/q") for n in range(4)], "archive_id int, ordinal int, response int, url string")
    leaves = spark.createDataFrame([(10 + n, "videoId", f"abcdef{n % 2}") for n in range(4)], "response int, path string, value string")
    out = M.page_identity_posts(asked, saved, leaves)
    assert rows(out, "id") == [(n, 10 + n % 2, 1) for n in range(6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [archive_id" in x and "page#" in x and "values" not in x for x in plan.splitlines())


def test_variants_are_looked_for_only_where_nothing_is_saved(spark):
    res = spark.createDataFrame([(1, 1, "https://a.example/x?v=1&id=7", "", 200, 9), (1, 2, "https://i.ytimg.com/vi/clipclip/hqdefault.jpg", "image/jpeg", 200, 9)], "archive_id int, ordinal int, url string, mime_type string, status int, size int")
    aliases = spark.createDataFrame([(1, "https://a.example/x?v=3&id=7", "https://a.example/x?v=1&id=7"), (1, "https://a.example/x?v=3&id=7", "https://a.example/gone")], "archive_id int, alias string, target string")
    asked = ["https://a.example/x?v=1&id=7", "https://a.example/x?v=2&id=7", "https://a.example/x?v=3&id=7", "https://I.ytimg.com/vi/clipclip/hq720.jpg", "https://a.example/y"]
    out = P.resolve_resource(spark.createDataFrame([(1, u) for u in asked], "archive_id int, target string"), res, aliases)
    assert dict(map(tuple, out.select("target", "via").collect())) == dict(zip(asked, ["direct", "query-variant", "alias", "image-size", "none"], strict=True))
    # the ways are joined to each request; they aren't listed below each other, grouped and sorted
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sites_of_a_redirect_are_worked_out_once(spark):
    found = [None, "", "https://www.example.com/a", "https://b.example.com/", "https://c.other.net/x", "https://d.other.net/", "ftp://x/"]
    df = spark.createDataFrame([(a, b, d) for a in found for b in found for d in (None, 0, 3)], "a string, b string, d int")
    start = F.lit("https://www.example.com/")
    outside = lambda u: urls.classify_scope(start, F.col(u)) == "external"
    same = urls.registrable_domain(urls.parts(F.col("a"))["host"]) == urls.registrable_domain(urls.parts(F.col("b"))["host"])
    reached = F.greatest(F.lit(1), F.coalesce("d", F.lit(1)))
    depth = F.when(~outside("b"), 0).when(F.coalesce(same, F.lit(False)), reached).when(outside("a"), reached + 1).otherwise(1)
    out = df.select(urls.redirect_external_depth(start, F.col("a"), F.col("d"), F.col("b")).alias("depth"), depth.alias("plain"))
    assert out.filter("not depth <=> plain").collect() == []
    cuts = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString().count("a-z0-9.-]++")
    # each of the three URLs is cut in one place
    assert cuts(urls.redirect_external_depth(start, F.col("a"), F.col("d"), F.col("b"))) <= 3 * cuts(urls.parts(F.col("a")))


def test_page_identity_looks_at_all_responses(spark, tmp_path):
    """only the last 400 responses of a URL, or of its address, were looked at."""
    import random

    def plain(asked, saved, said):
        """id, response and score: every page against every response of its URL, or of its address."""
        at, out = lambda u: u.split("?")[0], []
        for n, archive, url, page in asked:
            same = [s for s in saved if s[0] == archive and s[3] == url] or [s for s in saved if s[0] == archive and at(s[3]) == at(url)]
            scored = [(-sum(v in page for v in said[s[2]]), len(said[s[2]]), s[1], s[2]) for s in same]
            if scored and min(scored)[0]:
                out.append((n, min(scored)[3], -min(scored)[0]))
        return out

    rng = random.Random(1)
    saved = [(1, n, 1000 + n, rng.choice(["https://h.example/q", "https://h.example/q", "https://h.example/p?a=1", "https://h.example/p?a=2"])) for n in range(1500)]
    # a value of all, values of many and values of one response each; some are named twice
    said = {r: ["channel", *([f"maker{r % 3}"] if r % 4 else []), f"video{r}", *(["channel"] if r % 5 == 0 else [])] for _, _, r, _ in saved}
    parts = ["channel", "maker0", "maker1", "maker2", "nothing", *(f"video{rng.randrange(1000, 2600)}" for _ in range(40))]
    asked = [(n, 1, rng.choice(["https://h.example/q", "https://h.example/p?a=1", "https://h.example/p?a=9", "https://h.example/none"]), "https://p.example/w?" + "&".join(rng.sample(parts, rng.randrange(4)))) for n in range(300)]
    given = [spark.createDataFrame(asked, "id int, archive_id int, url string, page_url string"), spark.createDataFrame(saved, "archive_id int, ordinal int, response int, url string"), spark.createDataFrame([(r, "videoId", v) for r, all_ in said.items() for v in all_], "response int, path string, value string")]
    want = plain(asked, saved, said)
    assert len(want) > 100 and sum(r < 1500 for _, r, _ in want) > 30
    assert rows(M.page_identity_posts(*given), "id") == want
    for crowd in (100, 0):
        assert rows(M.page_identity_posts(*given, crowd=crowd), "id") == want
    at = datetime(2024, 1, 1)
    equals_sql(spark, tmp_path, "JN16_page_identity", events=events(spark, [(at, 70, "view")] * 2000))


def long_pages(spark):
    """Pages whose terms stand behind 200,000 characters, among them one with entities and tags all over."""
    found = [(1, "<p>" + "word " * 60_000 + "Other things of and</p>"), (2, "<p>other &amp; <b>one</b> " * 20_000 + " and of ing"), (3, "<p>the other and of ing</p>"), (4, "<p>nothing</p>" * 30_000)]
    return spark.createDataFrame([(n, f"https://l.example/{n}", html) for n, html in found], "page_id long, url string, html string")


def test_search_finds_what_stands_late_in_a_page(spark, tmp_path):
    """only the first 200,000 characters of a text were indexed."""
    equals_sql(spark, tmp_path, "ORD4_search", pages=long_pages(spark))


def test_scan_finds_what_stands_late_in_a_page(spark, tmp_path):
    """only the first 200,000 characters of a text were scanned."""
    equals_sql(spark, tmp_path, "ORD4_search_scan", pages=long_pages(spark))

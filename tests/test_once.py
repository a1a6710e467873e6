"""What costs much is worked out once a row, and rows are shuffled no more often than needed."""

from pyspark.sql import functions as F

from webstrata.functions import text
from webstrata.operators import archives as A
from webstrata.operators import pages as P
from webstrata.operators import search_index as I

PARSED = "[a-z0-9.-]++"  # of the pattern of canonical URLs


def named(df, what):
    """How often the optimized plan names ``what``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_lines_of_changed_pages_are_cut_once(spark):
    """the lines of a side were cut for the status, for the filter and for what is shown, and its text three times in each."""
    page = "archive_id long, ordinal long, page_id long, url string, requested_url string, title string, html string"
    one = lambda html: spark.createDataFrame([(1, 1, 1, "https://a.example/", None, "t", html)], page)
    changed = P.archive_diff(one("<p>a &amp; b</p><p>c</p>"), one("<p>a &amp; b</p>")).filter("status = 'changed'")
    assert named(changed, "<template") == 2
    assert [(r.lines_old, r.lines_now) for r in changed.collect()] == [(["a & b"], ["a & b", "c"])]
    assert [(r.added, r.removed) for r in P.line_changes(P.archive_diff(one("<p>a</p><p>2</p>"), one("<p>a</p>"))).collect()] == [(1, 0)]


def test_white_space_is_collapsed_in_lines(spark):
    rows = spark.createDataFrame([("  a  b　　c <br>2 1\t\r\f d e  \n\n<p>0  </p> ",)], "html string")
    got = rows.select(text.html_to_lines(F.col("html")).alias("lines"), text.collapse(F.col("html")).alias("line")).first()
    assert got.lines == ["a b c", "2 1 d e", "0"] and got.line == "a b c <br>2 1 d e <p>0 </p>"


def test_quality_parses_each_url_once(spark):
    """URLs of failures and misses were parsed in every row, and resources read and shuffled once for each of two looks."""
    blocked = spark.createDataFrame([(1, 1, u, "タイムアウト", 0) for u in ("https://a.example/x", "https://a.example/y", "https://a.example/z", "https://a.example/w", None)] + [(2, 2, "https://a.example/x", "タイムアウト", 0)], "archive_id long, ordinal long, url string, reason string, depth int")
    res = spark.createDataFrame([(1, "https://a.example/x", 404, 9, False), (1, "https://a.example/x", 200, 9, False), (1, "https://a.example/y", 404, 9, False), (1, "https://b.example/t", 200, 9, False)], "archive_id long, url string, status int, size long, empty_confirmed boolean")
    aliases = spark.createDataFrame([(1, "https://a.example/y", "https://b.example/t"), (1, "https://a.example/z", "https://b.example/t"), (1, "https://a.example/w", "https://b.example/none")], "archive_id long, alias string, target string")
    failures = A.unresolved_failures(blocked, res, aliases)
    assert sorted((r.archive_id, r.url or "") for r in failures.collect()) == [(1, ""), (1, "https://a.example/w"), (1, "https://a.example/y"), (2, "https://a.example/x")]
    pages = spark.createDataFrame([], "archive_id long, scope string, classification string, level string")
    jobs = spark.createDataFrame([(1, "https://a.example/", 0, "complete"), (2, "https://b.example/", 0, "complete")], "archive_id long, start_url string, errors int, status string")
    misses = res.select("archive_id", "url", F.lit(False).alias("repaired"))
    out = A.archive_quality(pages, failures, jobs, misses, res.select("archive_id", F.lit("ok").alias("state"), F.lit(True).alias("checked")))
    assert named(out, PARSED) == 0
    assert [(r.hard_blocked, r.external_hard_blocked, r.runtime_missing) for r in out.orderBy("archive_id").collect()] == [(2, 1, 4), (0, 1, 0)]


def test_query_variants_parse_each_url_once(spark):
    """requests and resources were parsed in every row, and resources read once more for the ordinal."""
    asked = spark.createDataFrame([(1, "https://a.example/p?v=9&id=3"), (2, "https://a.example/p?v=9&id=3"), (1, "https://a.example/p?v=9&id=a%20b"), (1, "/p?id=3"), (1, None)], "archive_id long, target string")
    res = spark.createDataFrame([(1, 7, "https://a.example/p?id=3&v=1", 200, 5), (1, 5, "https://a.example/p?id=3&v=2", 200, 5), (1, 3, "https://a.example/p?id=3&v=4", 404, 5), (1, 4, "https://a.example/p?id=a+b&v=1", 200, 5), (1, 1, None, 200, 5)], "archive_id long, ordinal long, url string, status int, size long")
    out = P.query_variant(asked, res)
    assert named(out, PARSED) == 0
    assert sorted((r.archive_id, r.target[-5:], r.url, r.ordinal) for r in out.collect()) == [(1, "&id=3", "https://a.example/p?id=3&v=2", 5), (1, "a%20b", "https://a.example/p?id=a+b&v=1", 4)]


def test_issues_look_at_each_url_and_reason_once(spark):
    """the category of a row was worked out twice, from a URL parsed in every row."""
    blocked = spark.createDataFrame([(k, 1, "https://a.example/x", "HTTP 404") for k in (1, 2)] + [(1, 2, "https://a.example/login/", None), (1, 3, None, "HTTP 404")], "archive_id long, ordinal long, url string, reason string")
    none = spark.createDataFrame([], "archive_id long, ordinal long, url string, classification string, reason string")
    out = A.issue_report(blocked, blocked.filter("false"), none)
    assert named(out.select("archive_id", "category", "n"), PARSED) <= 1  # that of pages
    assert sorted((r.archive_id, r.category, r.n) for r in out.collect()) == [(1, "login", 1), (1, "originMissing", 1), (2, "originMissing", 1)]


def test_storage_looks_at_each_type_and_url_once(spark):
    """URLs were parsed in every row."""
    files = spark.createDataFrame([(1, 1, "a", None, 5, None, "https://a.example/x.mp4"), (2, 1, "a", None, 6, "image/png", "https://a.example/x"), (1, 2, "b", None, 7, None, None), (1, 3, "c", "warc", 8, None, None)], "archive_id long, ordinal long, file string, category string, size long, mime_type string, url string")
    out = A.storage_summary(files).filter("n > 0")
    assert named(out, PARSED) == 0
    assert sorted((r.archive_id, r.category, r.bytes) for r in out.collect()) == [(1, "media", 5), (1, "other", 7), (1, "warc", 8), (2, "image", 6)]


def counted(spark, rows):
    """docs of (rank, text) and a counter of the texts made."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(x):
        n.add(1)
        return x

    docs = spark.createDataFrame([(k, f"u{k}", x) for k, x in rows], "rank long, url string, x string")
    return docs.select("rank", "url", F.lit("T").alias("title"), made.asNondeterministic()("x").alias("text")), n


ROWS = [(3, "the one and other"), (1, "And then"), (2, "the"), (4, None)]


def test_index_makes_each_text_once(spark, tmp_path):
    """a range sort reads its rows twice, so each text was made twice."""
    docs, n = counted(spark, ROWS)
    index = I.build_index(docs, f"file://{tmp_path}/index")
    assert n.value == len(ROWS)
    assert [(r.rank, r.total) for r in I.search_index(index, spark, "The  AND").collect()] == [(1, 2), (3, 2)]


def test_search_makes_each_text_once(spark):
    """F16: a text was made for each term, for the snippet and for the total."""
    docs, n = counted(spark, ROWS)
    assert [(r.rank, r.total, r.snippet) for r in P.search(docs, "The  AND").collect()] == [(1, 2, "And then…"), (3, 2, "the one and other…")]
    assert n.value == len(ROWS)
    docs = spark.createDataFrame([(1, "<p>the &amp; and</p>")], "rank long, html string").select("rank", F.lit("u").alias("url"), F.lit("T").alias("title"), text.html_to_search_text(F.col("html")).alias("text"))
    assert named(P.search(docs, "the and"), "<script") == 0

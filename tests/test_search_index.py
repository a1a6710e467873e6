"""The persisted search index against a scan of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from webstrata.operators import pages as P
from webstrata.operators import search_index as I


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = ["the", "and", "İstanbul", "section", "in", "ab", "abab", "aaa", "É", "日本語", "x", "foo-bar", "𝒳y"]
    rows = [(i, f"https://a.example/{i}", rng.choice([None, "Title", "aab"]), None if i % 19 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(300)]
    rows += [(900, "u", None, None), (901, "u", "", ""), (902, "long", "t", "word " * 60_000 + "needle")]
    return spark.createDataFrame(rows, "rank long, url string, title string, text string").repartition(3)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return I.build_index(docs, f"file://{tmp_path_factory.mktemp('index')}/i")


QUERIES = ["the and", "THE  section in", "ababab", "abab ab a", "aaaa", "aab", "日本", "語", "本語 É", "foo-bar x", "𝒳y", "zzz", "zz", "q", "", "needle word", "title", "the and in x a b ab the section zzz", "e a", "istanbul", "rd nee"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_a_scan(spark, docs, index, query):
    got = [tuple(r) for r in I.search_index(index, spark, query, 40).collect()]
    want = [tuple(r) for r in P.search(docs, query, 40).collect()]
    assert got == want


def scanned(df):
    """Rows that the file scans of a plan put out when it runs."""
    run = df._jdf.queryExecution()
    run.toRdd().count()

    def leaves(plan):
        name = plan.getClass().getSimpleName()
        if name in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            return leaves(plan.executedPlan() if name.startswith("Adaptive") else plan.plan())
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [x for c in children for x in leaves(c)] if children else [plan]

    return sum(x.metrics().apply("numOutputRows").value() for x in leaves(run.executedPlan()))


def test_a_search_reads_the_postings_it_asks_for(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(500)]
    rows = [(i, "u", "t", " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "rank long, url string, title string, text string")
    made = I.build_index(docs, f"file://{tmp_path}/i")
    terms = vocabulary[:8]
    wanted = I.read_postings(made, spark, terms)
    read, of, used = scanned(wanted), made.postings(spark).count(), wanted.count()
    assert read < 3 * used + 50_000 and read < of / 8


def test_an_index_is_kept_until_its_files_change(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    make = lambda n: spark.range(n).select(F.col("id").alias("rank"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.concat(F.lit("text "), "id").alias("text"))
    make(20).write.parquet(table)
    source = spark.read.parquet(table)
    one = I.index_of(source, source, "t")
    assert I.index_of(source, source, "t") == one
    make(30).write.mode("append").parquet(table)
    source = spark.read.parquet(table)
    two = I.index_of(source.dropDuplicates(["rank"]), source, "t")
    assert two != one and two.docs(spark).count() == 30
    assert [r.rank for r in I.search_index(two, spark, "text 29").collect()] == [29]


def test_an_index_of_an_earlier_version_is_not_read(spark, tmp_path, monkeypatch):
    """an index with cut texts was kept as long as the files were the same."""
    spark.range(5).select(F.col("id").alias("rank"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("cut").alias("text")).write.parquet(f"file://{tmp_path}/t")
    source = spark.read.parquet(f"file://{tmp_path}/t")
    one = I.index_of(source, source, "t")
    monkeypatch.setattr(I, "VERSION", I.VERSION + 1)
    assert I.index_of(source, source, "t") != one

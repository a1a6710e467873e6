"""A persisted substring index over pages: trigram postings with positions.

Every place of a document's lower-cased title and text begins a trigram (the end is padded), coded as one number. A posting has the places of a trigram in a document.
Postings lie in folders by the first character, sorted by trigram and document, in small pages; so a search opens only the folders and pages of the trigrams that
cover its terms. A term is found where its trigrams stand at the right distances, which needs no look at the text; terms of one or two characters are ranges of trigrams. The texts
of the few documents that are shown are read for their snippets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_root
from .pages import snippets

#: bits of a character in a trigram's code, the code that pads a document's end, folders of postings, values of an IN that Parquet filters one by one
BITS, END, FOLDERS, AT_ONCE = 21, (1 << 21) - 1, 64, 10
#: raised when the same files give other texts or postings than before, so that an index of an earlier version isn't read
VERSION = 2
SMALL_PAGES = {"parquet.page.row.count.limit": "1000"}
POSTINGS = "folder int, trigram long, doc long, places array<int>"


def code(characters: list[int]) -> int:
    a, b, c = characters
    return a << 2 * BITS | b << BITS | c


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole documents (doc, lower-cased text); a document's places are sorted by trigram once."""
    for batch in batches:
        for doc, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = np.concatenate([np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), [END, END]])
            codes = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
            if not len(codes):
                continue
            order = np.argsort(codes, kind="stable")
            ordered = codes[order]
            first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
            trigrams = ordered[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), pa.array(order, pa.int32()))
            folder = (trigrams >> 2 * BITS) % FOLDERS
            yield pa.RecordBatch.from_arrays([pa.array(folder, pa.int32()), pa.array(trigrams), pa.array(np.full(len(first), doc, np.int64)), places], names=["folder", "trigram", "doc", "places"])


@dataclass(frozen=True)
class SearchIndex:
    """Folders of an index: its postings and its documents."""

    path: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")

    def docs(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("doc long, url string, title string, text string").parquet(f"{self.path}/docs")


def build_index(docs: DataFrame, path: str) -> SearchIndex:
    """Write the index of ``docs`` (rank, url, title, text), one row for each rank, to ``path``. Null titles and texts are empty; rows with a null rank are left out."""
    rows = docs.filter("rank is not null").select(F.col("rank").cast("long").alias("doc"), "url", "title", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range reads its rows twice: texts are written before it and not made again, while postings are made faster than written
    rows = cut(rows)
    rows.repartitionByRange(n, "doc").sortWithinPartitions("doc").write.options(**SMALL_PAGES).parquet(f"{path}/docs")
    kept = SearchIndex(path)
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    made = kept.docs(docs.sparkSession).select("doc", hay.alias("low")).mapInArrow(_postings, POSTINGS)
    # by document too, so that a trigram of all documents is many files
    made.repartitionByRange(n, "folder", "trigram", "doc").sortWithinPartitions("folder", "trigram", "doc").write.options(**SMALL_PAGES).partitionBy("folder").parquet(f"{path}/postings")
    return kept


def index_of(docs: DataFrame, source: DataFrame, name: str) -> SearchIndex:
    """The index of ``docs``, which come from the files of ``source``. It is kept in the shared folder under the names, sizes and times of these files and built only if they, or ``VERSION``, have changed."""
    spark = docs.sparkSession
    meta = source.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    state = meta.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p", "s", "t")).alias("h")).first()
    root = f"{shared_root(spark)}/search-{name}-v{VERSION}-{state.n}-{(state.h or 0) & (1 << 64) - 1:016x}"
    # each build has a folder of its own, which ends with a marker: half of an index is never read
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/postings/_SUCCESS")
    found = marker.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marker)
    if found:
        return SearchIndex(f"{root}/{min(f.getPath().getParent().getParent().getName() for f in found)}")
    return build_index(docs, f"{root}/{uuid.uuid4().hex}")


def terms_of(query: str) -> list[str]:
    """At most eight lower-case terms."""
    return [t for t in query.lower().split() if t][:8]


def covering(term: str) -> list[tuple[int, int]]:
    """(distance, trigram) of trigrams that cover a term of three characters or more: every third, and the last."""
    points = [ord(c) for c in term]
    at = sorted({*range(0, len(points) - 2, 3), len(points) - 3})
    return [(i, code(points[i : i + 3])) for i in at]


def read_postings(index: SearchIndex, spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, distance, doc, places): the postings that the terms ask for, and no others."""
    asked: dict[int, list[tuple[int, int]]] = {}
    ranges = []
    for k, term in enumerate(terms):
        if len(term) >= 3:
            for distance, trigram in covering(term):
                asked.setdefault(trigram, []).append((k, distance))
        else:
            points = [ord(c) for c in term]
            low = code([*points, 0, 0][:3])
            ranges.append((k, points[0] % FOLDERS, low, low + (1 << BITS * (3 - len(points))) - 1))
    postings, parts = index.postings(spark), []
    for folder in sorted({(t >> 2 * BITS) % FOLDERS for t in asked}):
        mine = sorted(t for t in asked if (t >> 2 * BITS) % FOLDERS == folder)
        for some in (mine[i : i + AT_ONCE] for i in range(0, len(mine), AT_ONCE)):
            uses = F.create_map(*[x for t in some for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("term"), F.lit(d).alias("distance")) for k, d in asked[t]]))])
            rows = postings.filter((F.col("folder") == folder) & F.col("trigram").isin(some))
            parts.append(rows.select(F.explode(uses[F.col("trigram")]).alias("u"), "doc", "places").select("u.term", "u.distance", "doc", "places"))
    for k, folder, low, high in ranges:
        rows = postings.filter((F.col("folder") == folder) & F.col("trigram").between(low, high))
        parts.append(rows.select(F.lit(k).alias("term"), F.lit(0).alias("distance"), "doc", "places"))
    return reduce(DataFrame.unionByName, parts)


def matching(index: SearchIndex, spark: SparkSession, terms: list[str]) -> DataFrame:
    """(doc): documents that hold all terms. The places of a term's trigrams, moved to its start, are intersected."""
    rows = read_postings(index, spark, terms)
    starts = F.transform("places", lambda p: p - F.col("distance"))
    held = rows.groupBy("doc").agg(F.collect_list(F.struct("term", F.when(F.lit(True), starts).alias("starts"))).alias("held"))

    def found(k: int, term: str) -> Column:
        mine = F.transform(F.filter("held", lambda h: h["term"] == k), lambda h: h["starts"])
        if len(term) < 3:
            return F.size(mine) > 0
        common = F.aggregate(F.slice(mine, 2, F.greatest(F.size(mine), F.lit(1))), mine[0], lambda a, b: F.array_intersect(a, b))
        return (F.size(mine) == len(covering(term))) & (F.size(common) > 0)

    return held.filter(reduce(lambda a, b: a & b, [found(k, t) for k, t in enumerate(terms)])).select("doc")


def search_index(index: SearchIndex, spark: SparkSession, query: str, limit: int = 50) -> DataFrame:
    """rank, url, title, snippet and total as ``pages.search`` gives them, through the index."""
    terms = terms_of(query)
    docs = index.docs(spark).withColumnRenamed("doc", "rank")
    if not terms:
        return snippets(docs.filter("false"), ["x"]).withColumn("total", F.lit(0).cast("long"))
    hits = matching(index, spark, terms)
    hits = cut(hits)  # ids only
    shown = hits.orderBy("doc").limit(limit).collect()  # at most ``limit`` rows
    total = hits.count() if len(shown) == limit else len(shown)
    if not shown:
        return snippets(docs.filter("false"), terms).withColumn("total", F.lit(0).cast("long"))
    ranks = [r.doc for r in shown]
    few = docs.filter(F.col("rank").between(ranks[0], ranks[-1]) & F.col("rank").isin(ranks))
    return snippets(few, terms).withColumn("total", F.lit(total).cast("long")).orderBy("rank")

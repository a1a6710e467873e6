"""Readers and writers of JSON line logs, record folders and content-addressed blobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import latest_by_url, parse_index_lines

ARCHIVE = "id string, startUrl string, title string, status string, savedAt timestamp, bytes bigint, errors int, folder string, tags array<string>, note string"
MANIFEST = """id string, startUrl string, createdAt timestamp,
 pages array<struct<url:string,requestedUrl:string,title:string,depth:int,html:string,links:array<string>,resources:array<string>,capturedAt:timestamp>>,
 resources map<string,struct<url:string,status:int,mimeType:string,digest:string,file:string,size:bigint,capturedAt:timestamp>>,
 resourceAliases map<string,string>, blocked array<struct<url:string,reason:string,depth:int>>"""


def read_records(spark: SparkSession, folder: str, schema: str = ARCHIVE) -> DataFrame:
    """JSON records, one a file, with a given schema; broken files are rows of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)


def manifest_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    """pages, resources, resource_aliases and blocked of manifests; ordinal is the place in the array."""
    m = manifests.withColumnRenamed("id", "archive_id")
    pages = m.select("archive_id", F.posexplode("pages").alias("ordinal", "p")).select("archive_id", "ordinal", "p.*")
    resources = m.select("archive_id", F.explode("resources").alias("url", "r")).select("archive_id", "url", "r.status", F.col("r.mimeType").alias("mime_type"), "r.digest", "r.file", "r.size", F.col("r.capturedAt").alias("captured_at"))
    aliases = m.select("archive_id", F.explode("resourceAliases").alias("alias", "target"))
    blocked = m.select("archive_id", F.posexplode("blocked").alias("ordinal", "b")).select("archive_id", "ordinal", "b.*")
    return {"pages": pages, "resources": resources, "resource_aliases": aliases, "blocked": blocked}


def read_search_index(spark: SparkSession, path: str) -> DataFrame:
    """Latest entry of each URL of an append-only index; lines are numbered by file and place, broken ones skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return latest_by_url(parse_index_lines(lines))


def append_search_index(pages: DataFrame, path: str) -> None:
    """Append url, title and search text of pages as JSON lines."""
    from ..functions.text import html_to_search_text

    pages.select("url", F.coalesce("title", F.lit("")).alias("title"), html_to_search_text(F.col("html")).alias("text")).write.mode("append").json(path)


def write_by_day(records: DataFrame, path: str, ts: str = "ts") -> None:
    """Append records to day partitions, which retention drops whole."""
    records.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def store_blobs(bodies: DataFrame, path: str) -> DataFrame:
    """Write each distinct body once, in folders by the first two digits of its SHA-256; returns (id, digest, size) of all.

    A stored body counts only if it still has its digest; a damaged one is written again, and ``read_blobs`` gives whole ones only, each once,
    so that two runs at once do no harm.
    """
    hashed = bodies.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    once = hashed.groupBy("digest").agg(F.first("body").alias("body")).withColumn("prefix", F.substring("digest", 1, 2))
    try:
        once = once.join(read_blobs(bodies.sparkSession, path).select("digest"), "digest", "left_anti")
    except AnalysisException as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    once.write.mode("append").partitionBy("prefix").parquet(path)
    return hashed.select("id", "digest", "size")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(digest, body): stored bodies that have the digest they are filed under, each once."""
    rows = spark.read.schema("digest string, body binary, prefix string").parquet(path)
    return rows.filter(F.sha2("body", 256) == F.col("digest")).groupBy("digest").agg(F.first("body").alias("body"))


def page_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url, title) of the latest entry of each URL; the texts of the index aren't parsed.

    line_no: struct of file, block and place. Files go by name: Spark deals out larger ones first, so the numbers it gives don't follow their order.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(at.alias("line_no"), F.from_json("value", "url string, title string").alias("r"))
    kept = lines.select("line_no", "r.url", "r.title").filter("url is not null")
    return kept.groupBy("url").agg(F.min("line_no").alias("line_no"), F.max_by("title", "line_no").alias("title"))


def recent_files(files: DataFrame, limit: int = 10) -> DataFrame:
    """The newest log files (name, modified): by time, then by name, both downwards."""
    return files.filter(F.col("name").endswith(".jsonl")).orderBy(F.desc("modified"), F.desc("name")).limit(limit)


def log_tail(spark: SparkSession, folder: str, lines: int, limit: int = 10) -> DataFrame:
    """The last ``lines`` records (event_id, level) of the newest files of a log folder."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    newest = recent_files(found, limit)
    rows = spark.read.schema("event_id long, level string").json(folder).select("*", F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("_n"))
    kept = rows.join(F.broadcast(newest), "name")  # at most ``limit`` rows
    return kept.orderBy(F.desc("modified"), F.desc("name"), F.desc("_n")).limit(lines).select("event_id", "level")


def expire_days(spark: SparkSession, path: str, today, keep: int = 7) -> DataFrame:
    """The records of day partitions that aren't older than ``keep`` days; older folders aren't read."""
    return spark.read.parquet(path).filter(F.datediff(today, F.col("day")) < keep)


def valid_blobs(files: DataFrame) -> DataFrame:
    """Files (path) that are blobs: a folder of two hex digits and a name of 64 that begins with them."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    return files.filter(name.rlike("^[a-f0-9]{64}$") & folder.rlike("^[a-f0-9]{2}$") & name.startswith(folder))


def disk_usage(files: DataFrame) -> DataFrame:
    """One row: bytes of files (device, inode, size), hard links counted once."""
    return files.groupBy("device", "inode").agg(F.max("size").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))

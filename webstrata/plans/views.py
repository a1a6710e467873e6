"""A captured web over the driver's generic tables: the same SQL text defines each view in Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["orders", "lineitem", "pages", "events", "documents"]

SQL = {
    "archives": """
SELECT o_orderkey AS archive_id,
  'https://' || CASE WHEN o_custkey % 3 = 0 THEN 'www.' WHEN o_custkey % 3 = 1 THEN 'docs.' ELSE '' END || 'site' || CAST(o_custkey % 211 AS STRING) || CASE WHEN o_custkey % 5 = 0 THEN '.co.jp' ELSE '.example' END || '/' AS start_url,
  'Archive ' || CAST(o_orderkey % 50 AS STRING) AS title,
  CASE o_orderkey % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'limit-reached' WHEN 2 THEN 'complete-with-errors' WHEN 3 THEN 'running' ELSE 'complete' END AS status,
  o_orderdate AS saved_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS folder,
  'tag' || CAST(o_orderkey % 7 AS STRING) || ', tag' || CAST(o_custkey % 5 AS STRING) || ',,x' AS tags_text,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes, CAST(o_orderkey % 4 AS INT) AS errors,
  CASE WHEN o_orderkey % 6 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE NULL END AS previous_archive_id
FROM {orders}""",
    "resources": """
SELECT l_orderkey AS archive_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS ordinal,
  'https://cdn' || CAST(l_suppkey % 13 AS STRING) || '.example/' || CASE l_partkey % 9 WHEN 0 THEN 'v/clip.mp4' WHEN 1 THEN 'i/a.png' WHEN 2 THEN 'f/x.woff2' WHEN 3 THEN 'js/app.js' WHEN 4 THEN 'css/main.css' WHEN 5 THEN 'page' WHEN 6 THEN 'api/data' WHEN 7 THEN 'i/b.jpg' ELSE 'bin/seg' || CAST(l_linenumber AS STRING) || '.ts' END
    || '?v=' || CAST(l_partkey % 40 AS STRING) || '&id=' || CAST(l_partkey % 12 AS STRING) AS url,
  CASE l_partkey % 9 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' WHEN 2 THEN 'font/woff2' WHEN 3 THEN 'text/javascript' WHEN 4 THEN 'text/css' WHEN 5 THEN 'text/html' WHEN 6 THEN 'application/json' ELSE '' END AS mime_type,
  CASE WHEN l_suppkey % 17 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN l_quantity < 3 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS size,
  'blobs/' || CAST(l_partkey % 500 AS STRING) AS file, 'd' || CAST(l_partkey % 500 AS STRING) AS digest, CAST(1 + l_partkey % 2 AS INT) AS nlink, l_linenumber = 7 AS empty_confirmed, l_shipdate AS saved_at
FROM {lineitem}""",
    "blocked": """
SELECT l_orderkey AS archive_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS ordinal,
  CASE l_suppkey % 5 WHEN 0 THEN 'https://accounts.google.com/gsi/' || CAST(l_partkey % 20 AS STRING) WHEN 1 THEN 'https://www.site' || CAST(l_partkey % 20 AS STRING) || '.example/login/' ELSE 'https://cdn' || CAST(l_suppkey % 13 AS STRING) || '.example/x/' || CAST(l_partkey % 60 AS STRING) END AS url,
  CASE l_suppkey % 14 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN '取得できませんでした' WHEN 2 THEN 'HTTP 403 Forbidden' WHEN 3 THEN 'タイムアウトしました' WHEN 4 THEN 'net::ERR_FAILED' WHEN 5 THEN 'robots.txt で対象外' WHEN 6 THEN 'ログイン誘導先は保存済みです: https://a.example/' WHEN 7 THEN '本文が空でした' WHEN 8 THEN '取得深度上限' WHEN 9 THEN 'fetch failed' WHEN 10 THEN 'ブラウザがキャプチャ開始前に終了' WHEN 11 THEN '読み込みに失敗' WHEN 12 THEN 'ページを開けませんでした' ELSE NULL END AS reason,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber AS INT) END AS depth
FROM {lineitem} WHERE l_linenumber >= 4""",
    "aliases": """
SELECT DISTINCT l_orderkey AS archive_id, 'https://cdn' || CAST(l_suppkey % 13 AS STRING) || '.example/x/' || CAST(l_partkey % 60 AS STRING) AS alias, 'https://cdn' || CAST(l_suppkey % 13 AS STRING) || '.example/api/data?v=' || CAST(l_partkey % 40 AS STRING) || '&id=' || CAST(l_partkey % 12 AS STRING) AS target
FROM {lineitem} WHERE l_linenumber = 5""",
    "captures": """
SELECT page_id % 40 AS archive_id, page_id AS ordinal, page_id, url,
  CASE WHEN page_id % 13 = 0 THEN 'https://start.example/in?nonce=1' WHEN page_id % 5 = 0 THEN NULL ELSE url END AS requested_url,
  CASE page_id % 11 WHEN 0 THEN 'Just a moment...' WHEN 1 THEN 'Log in' WHEN 2 THEN '404 Not Found' WHEN 3 THEN 'Page not found | Shop' ELSE 'Title ' || CAST(page_id AS STRING) END AS title,
  CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 11 = 1 THEN html || '<input type="password">' ELSE html END AS html,
  CASE WHEN page_id % 19 = 0 THEN 503 ELSE 200 END AS status, CASE WHEN page_id % 3 = 0 THEN 'external' ELSE 'site' END AS scope,
  CAST(page_id % 6 AS INT) AS depth, page_id % 23 = 0 AS partial
FROM {pages}""",
    "log": """
SELECT event_id AS sequence, ts, CASE event_type WHEN 'error' THEN 'warn' ELSE 'info' END AS level, 'c' || CAST(user_id % 5 AS STRING) AS component, event_type AS event, user_id, value FROM {events}""",
    "links": """
SELECT 'https://g' || CAST(l_suppkey % 3 AS STRING) || '.example/' || CAST(l_partkey % 700 AS STRING) AS src, 'https://g' || CAST(l_linenumber % 3 AS STRING) || CASE WHEN l_linenumber = 7 THEN '.other' ELSE '.example' END || '/' || CAST((l_partkey * 7 + l_linenumber) % 700 AS STRING) AS dst
FROM {lineitem} WHERE l_quantity > 25""",
    "posts": """
SELECT event_id AS id, user_id % 10 AS archive_id, 'POST' AS method, 'https://api.example/q' || CAST(user_id % 7 AS STRING) AS url, props AS body, event_id AS ordinal, ts FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def cte(*names: str) -> str:
    """The same views as a WITH clause."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" if n not in TABLES else f"v_{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names) + "\n"

"""The catalogue's tables, bound to the driver's by SQL that Spark and DuckDB both read.

{hash} stands for the SHA-256 of the id as text, whose function is named differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlake.plans.query import Catalog

SQL = {
    "photos": """
SELECT o_orderkey AS id, {hash} AS content_hash,
  CASE WHEN o_orderkey % 2 = 0 THEN 'IMG_' ELSE 'img_' END || CAST(o_orderkey % 997 AS STRING) || '.jpg' AS file_name,
  '/photos/' || o_orderpriority AS source_folder, o_orderkey * 37 % 100003 AS file_size,
  o_orderdate AS captured_utc, o_orderdate AS indexed_utc,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Canon' WHEN 2 THEN 'NIKON' ELSE 'Sony' END AS camera_make,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EOS R' || CAST(o_custkey % 7 AS STRING) ELSE 'model-' || CAST(o_custkey % 9 AS STRING) END AS camera_model,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey * 7919 % 18001 AS DOUBLE) / 100 - 90 END AS latitude,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey * 104729 % 36001 AS DOUBLE) / 100 - 180 END AS longitude,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'city ' || CAST(o_custkey % 50 AS STRING) END AS place_city,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'country ' || CAST(o_custkey % 9 AS STRING) END AS place_country,
  CAST(o_orderkey % 5 AS INT) AS state, CAST(o_orderkey % 6 AS INT) AS rating, o_orderkey % 6 >= 5 AS is_favourite,
  CASE WHEN o_orderkey % 7 = 0 THEN 'a sunset over ' || o_orderpriority WHEN o_orderkey % 7 = 1 THEN '  ' ELSE NULL END AS ai_description,
  CASE WHEN o_orderkey % 13 = 0 THEN ' My title ' ELSE NULL END AS user_title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'a red boat, número ' || CAST(o_orderkey % 40 AS STRING) ELSE '' END AS ai_caption,
  CAST(1 AS BIGINT) AS revision, CAST(NULL AS STRING) AS state_detail, CAST(NULL AS STRING) AS model_version
FROM orders""",
    "tags": """
SELECT DISTINCT event_id * 13 % 15000 + 1 AS photo_id, event_type AS tag, CAST(event_id % 3 AS INT) AS source, 1.0 AS confidence
FROM events""",
    "segments": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS id, l_orderkey AS photo_id,
  CASE l_partkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'dog' WHEN 2 THEN 'car' WHEN 3 THEN 'Person' ELSE 'tree' END AS label,
  CASE WHEN l_suppkey % 10 = 0 THEN 'boat' ELSE NULL END AS user_label,
  CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence, 'seg-' || CAST(l_suppkey % 2 AS STRING) AS model,
  CAST(l_partkey % 60 AS DOUBLE) / 100 AS x, CAST(l_suppkey % 50 AS DOUBLE) / 100 AS y,
  CAST(10 + l_partkey % 30 AS DOUBLE) / 100 AS w, CAST(10 + l_suppkey % 40 AS DOUBLE) / 100 AS h
FROM lineitem WHERE l_linenumber >= 0""",
    "faces": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS id, l_orderkey AS photo_id, CAST(l_suppkey % 100 AS DOUBLE) / 100 AS confidence,
  CAST(l_partkey % 70 AS DOUBLE) / 100 AS x, CAST(l_suppkey % 60 AS DOUBLE) / 100 AS y,
  CAST(5 + l_partkey % 20 AS DOUBLE) / 100 AS w, CAST(5 + l_suppkey % 20 AS DOUBLE) / 100 AS h,
  CAST((5 + l_partkey % 20) * (5 + l_suppkey % 20) AS DOUBLE) / 10000 AS area,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'face/' || CAST(l_partkey AS STRING) END AS crop_key,
  CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE NULL END AS person_id
FROM lineitem""",
    "people": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "members": "SELECT o_custkey % 6 AS collection_id, o_orderkey AS photo_id, CAST(o_orderkey % 100000 AS INT) AS position FROM orders WHERE o_orderkey % 4 = 0",
    "collections": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey % 5 / 4 AS INT) AS kind, CAST(NULL AS STRING) AS query_json,
  CAST(NULL AS BIGINT) AS cover_id, CAST(24 - n_nationkey AS INT) AS position FROM nation WHERE n_nationkey % 5 <> 3""",
    "jobs": """
SELECT user_id AS photo_id, stage, CAST(ord AS INT) AS ord, CASE WHEN v % 11 < 4 THEN 'pending' WHEN v % 11 < 5 THEN 'running' WHEN v % 11 < 7 THEN 'failed' WHEN v % 11 < 8 THEN 'skipped' ELSE 'done' END AS state,
  CASE WHEN v % 11 >= 8 THEN 'm' || CAST(v % 2 AS STRING) ELSE NULL END AS model, CAST(CASE WHEN v % 11 < 5 THEN v % 2 WHEN v % 11 < 7 THEN 1 + v % 4 ELSE 0 END AS INT) AS attempts,
  CASE WHEN v % 11 >= 5 AND v % 11 < 7 THEN 'no luck' ELSE NULL END AS error, t AS updated_at
FROM (SELECT user_id, stage, ord, sum(event_id) AS v, max(ts) AS t FROM events, (SELECT 0 AS ord, 'describe' AS stage UNION ALL SELECT 1, 'segment' UNION ALL SELECT 2, 'faces' UNION ALL SELECT 3, 'embed') AS s
  WHERE event_id % 5 <> ord GROUP BY user_id, stage, ord) AS g""",
}
HASH = {"spark": "sha2(CAST(o_orderkey AS STRING), 256)", "duckdb": "sha256(CAST(o_orderkey AS VARCHAR))"}
SOURCES = ("orders", "events", "lineitem", "supplier", "nation")


def view(name: str) -> str:
    """The table's SQL for DuckDB."""
    return SQL[name].replace("{hash}", HASH["duckdb"]).strip()


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({view(n)})" for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame; boxes also as a struct."""
    text = SQL[name].replace("{hash}", HASH["spark"])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    out = spark.sql(text, **used)
    if {"x", "y", "w", "h"} <= set(out.columns):
        out = out.selectExpr("*", "struct(x, y, w, h) AS box")
    return out


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(*(table(spark, sf_dir, n) for n in ("photos", "tags", "segments", "members")))

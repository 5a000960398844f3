"""Queries of problem 1: jobs and chats that name a book which is missing, deleted or later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.references import clean_key, latest_version, orphan_references, orphan_report, parse_time
from marginalia.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "chats").select(F.lit("chats").alias("source"), F.col("id").alias("record_id"), clean_key("book_id").alias("key"), parse_time("created_at").alias("at"))
    jobs = table(spark, sf_dir, "ingestion_jobs").select(F.lit("ingestion_jobs").alias("source"), F.col("id").alias("record_id"), clean_key("book_id").alias("key"), F.coalesce(parse_time("started_at"), parse_time("updated_at")).alias("at"))
    books = latest_version(table(spark, sf_dir, "books"), "id", "loaded_at", "created_at", "deleted_at")
    parents = books.select(F.col("id").alias("key"), parse_time("created_at").alias("born"), parse_time("deleted_at").alias("died"))
    return orphan_references(chats.unionByName(jobs), parents)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(F.col("source").alias("table_name"), "record_id").distinct()


def p1_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = orphan_report(_orphans(spark, sf_dir))
    return r.select(F.col("source").alias("table_name"), F.date_format("period", "yyyy-MM").alias("month"), "reason", "records")


_CASES = r"""
WITH b AS (
  SELECT id, created_at, deleted_at FROM books
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1
), r AS (
  SELECT 'chats' AS table_name, id AS record_id, nullif(lower(regexp_replace(book_id, '^\s+|\s+$', '', 'g')), '') AS k,
         CAST(created_at AS TIMESTAMPTZ) AS t FROM chats
  UNION ALL
  SELECT 'ingestion_jobs', id, nullif(lower(regexp_replace(book_id, '^\s+|\s+$', '', 'g')), ''),
         CAST(coalesce(started_at, updated_at) AS TIMESTAMPTZ) FROM ingestion_jobs
), c AS (
  SELECT DISTINCT r.table_name, r.record_id, r.t,
         CASE WHEN b.id IS NULL THEN 'missing'
              WHEN CAST(b.deleted_at AS TIMESTAMPTZ) <= r.t THEN 'deleted'
              WHEN CAST(b.created_at AS TIMESTAMPTZ) > r.t THEN 'later' END AS reason
  FROM r LEFT JOIN b ON r.k = b.id WHERE r.k IS NOT NULL
)
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month}
SQL = {
    "p1_found": _CASES + "SELECT DISTINCT table_name, record_id FROM c WHERE reason IS NOT NULL",
    "p1_orphans_by_month": _CASES + """SELECT table_name, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(DISTINCT record_id) AS records
FROM c WHERE reason IS NOT NULL GROUP BY ALL""",
}

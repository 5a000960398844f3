"""Queries of problem 4: the five best hits of every query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.top_hits import top_n
from marginalia.session import table

TOP = 5


def query_key(text: Column | str) -> Column:
    """Trimmed, runs of blanks and tabs as one blank, lower-cased; null where blank."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.nullif(F.lower(F.regexp_replace(trimmed, r"[ \t]+", " ")), F.lit(""))


def p4_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "candidates").filter("rank >= 1").select(query_key("query_text").alias("query_key"), "rank", "candidate_id", "hit_id")
    return top_n(hits, "query_key", ["rank", "candidate_id", "hit_id"], TOP)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_top_hits(spark, sf_dir).select("hit_id")


_TOP = r"""
WITH h AS (
  SELECT DISTINCT hit_id, rank, candidate_id, nullif(lower(regexp_replace(regexp_replace(query_text, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')), '') AS query_key
  FROM candidates WHERE rank >= 1
), t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY rank, candidate_id, hit_id) AS INTEGER) AS place FROM h WHERE query_key IS NOT NULL
)
"""

QUERIES = {"p4_found": p4_found, "p4_top_hits": p4_top_hits}
SQL = {
    "p4_found": _TOP + "SELECT hit_id FROM t WHERE place <= 5",
    "p4_top_hits": _TOP + "SELECT query_key, rank, candidate_id, hit_id, place FROM t WHERE place <= 5",
}

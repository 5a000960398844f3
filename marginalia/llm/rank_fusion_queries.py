"""Queries of problem 3: runs of each comparison in one ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.rank_fusion import first_of_each, fuse_ranks
from marginalia.session import table

#: Score column -> more is better.
SCORES = {"mrr": True, "hit_at_5_count": True, "required_point_coverage": True, "p95_latency_seconds": False}


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = table(spark, sf_dir, "leaderboard").groupBy("comparison_id", "run_id").agg(F.max(F.struct("recorded_at", "loaded_at", "required_point_coverage", "p95_latency_seconds")).alias("b"))
    metrics = table(spark, sf_dir, "evaluations").select("run_id", "recorded_at", *[F.col("metrics").getItem(m).alias(m) for m in ("mrr", "hit_at_5_count")])
    runs = metrics.groupBy("run_id").agg(F.max(F.struct("recorded_at", "mrr", "hit_at_5_count")).alias("e"))
    joined = board.join(runs, "run_id", "left").select("comparison_id", "run_id", "b.required_point_coverage", "b.p95_latency_seconds", "e.mrr", "e.hit_at_5_count")
    return fuse_ranks(joined, "comparison_id", "run_id", SCORES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(_fused(spark, sf_dir), "comparison_id", "run_id")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("comparison_id", "run_id", F.round("rrf", 9).alias("rrf"), "place")


_FUSED = """
WITH b AS (
  SELECT comparison_id, run_id, required_point_coverage, p95_latency_seconds FROM leaderboard
  QUALIFY row_number() OVER (PARTITION BY comparison_id, run_id ORDER BY recorded_at DESC, loaded_at DESC) = 1
), e AS (
  SELECT run_id, metrics['mrr'] AS mrr, metrics['hit_at_5_count'] AS hits FROM evaluations
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC) = 1
), s AS (
  SELECT b.comparison_id, b.run_id,
         coalesce(-e.mrr, max(-e.mrr) OVER g, 0) AS a1, coalesce(-e.hits, max(-e.hits) OVER g, 0) AS a2,
         coalesce(-required_point_coverage, max(-required_point_coverage) OVER g, 0) AS a3,
         coalesce(p95_latency_seconds, max(p95_latency_seconds) OVER g, 0) AS a4
  FROM b LEFT JOIN e USING (run_id) WINDOW g AS (PARTITION BY b.comparison_id)
), r AS (
  SELECT comparison_id, run_id, round(
    1.0::DOUBLE / (60 + rank() OVER (PARTITION BY comparison_id ORDER BY a1)) + 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY comparison_id ORDER BY a2))
    + 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY comparison_id ORDER BY a3)) + 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY comparison_id ORDER BY a4)), 12) AS rrf FROM s
), f AS (
  SELECT comparison_id, run_id, rrf, row_number() OVER (PARTITION BY comparison_id ORDER BY rrf DESC, run_id) AS place FROM r
)
"""

QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
SQL = {
    "p3_found": _FUSED + "SELECT comparison_id, run_id FROM f WHERE place = 1",
    "p3_ranking": _FUSED + "SELECT comparison_id, run_id, round(rrf, 9) AS rrf, place FROM f",
}

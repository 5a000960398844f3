"""Queries of problem 5: text pieces cut to at most 2,000 characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.pieces import split_texts
from marginalia.session import table


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces sent again are split once: rows equal in id and text are one."""
    stored = table(spark, sf_dir, "text_pieces").select("piece_id", "text").distinct()
    return split_texts(stored, "piece_id", "text").withColumnRenamed("id", "piece_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("pieces > 1").select("piece_id").distinct()


def p5_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pieces end, and how long they are."""
    return _pieces(spark, sf_dir).groupBy("boundary").agg(F.count("*").alias("pieces"), F.max(F.length("text")).alias("longest"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_boundaries": p5_boundaries}
SQL = {"p5_found": "SELECT DISTINCT piece_id FROM text_pieces WHERE length(text) > 2000"}

"""Queries of problem 2: pages that are running prose, and pages that are lists, tables or junk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.text_quality import STATISTICS, score_texts
from marginalia.session import table

#: Pages of fewer characters after trimming are no cases.
LEAST_CHARACTERS = 40


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page and text; pages sent again with the same text are one."""
    results = table(spark, sf_dir, "validation_results").select("result_id", F.explode("pages").alias("p"))
    pages = results.select("result_id", "p.pdf_page_number", F.col("p.cleaned_text").alias("text"))
    long_enough = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= LEAST_CHARACTERS
    return pages.filter(long_enough).dropDuplicates()


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every page beside those its validation result keeps."""
    kept = table(spark, sf_dir, "validation_results").groupBy("result_id").agg(F.max(F.struct("loaded_at", *[F.col("metrics").getItem(m).alias(m) for m in ("median_text_characters", "alphabetic_character_ratio", "english_common_word_ratio")])).alias("kept"))
    scored = score_texts(_pages(spark, sf_dir), "text", ["result_id", "pdf_page_number"])
    return scored.join(kept, "result_id", "left").select("result_id", "pdf_page_number", "language", *STATISTICS, "outlier_score", "not_prose", "kept.median_text_characters", "kept.alphabetic_character_ratio", "kept.english_common_word_ratio")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_pages(spark, sf_dir), "text", ["result_id", "pdf_page_number"])
    return scored.filter("not_prose").select("result_id", "pdf_page_number").distinct()


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
SQL: dict[str, str] = {}

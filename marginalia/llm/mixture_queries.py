"""Queries of problem 7: a mix of the documents' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.containers import count_tokens
from marginalia.llm.mixture import mix
from marginalia.session import table


def _mix(spark: SparkSession, sf_dir: str, within_reach: bool = False) -> tuple[DataFrame, DataFrame]:
    return mix(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",)), table(spark, sf_dir, "mix_targets"), within_reach)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].filter("saturated").select("source")


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_shares_within_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mix in which every source that has documents reaches its target."""
    return _mix(spark, sf_dir, True)[1]


QUERIES = {"p7_found": p7_found, "p7_copies": p7_copies, "p7_shares": p7_shares, "p7_shares_within_reach": p7_shares_within_reach}
SQL: dict[str, str] = {}

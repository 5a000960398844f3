"""Queries of problem 6: documents in containers of 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.containers import CAPACITY, count_tokens, fill_containers
from marginalia.session import table


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_containers(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return filled.withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_containers(spark, sf_dir).filter("pieces > 1").select("doc_id").distinct()


def p6_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, and the fewest containers the tokens could fill."""
    f = p6_containers(spark, sf_dir).filter("container IS NOT NULL")
    each = f.groupBy("container").agg(F.sum("piece_tokens").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.ceil(F.sum("used") / CAPACITY).alias("fewest"))


QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p6_space": p6_space}
SQL: dict[str, str] = {}

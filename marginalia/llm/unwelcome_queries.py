"""Queries of problem 8: abusive, hateful or sexually explicit documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.unwelcome import known_words, rates, score_documents, source_key, train, word_background
from marginalia.session import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", source_key("source").alias("source"))
    labels = table(spark, sf_dir, "review_labels").select(F.col("doc_id").alias("id"), F.col("unwelcome").alias("label"))
    known = known_words(docs, labels)
    return score_documents(docs, "id", "text", train(docs, labels, word_background(docs, known), known), ("source",))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("passages > 0").select(F.col("id").alias("doc_id")).distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_scored(spark, sf_dir), "source")


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}

"""Queries over chunks, evidence selection, context packing and paired comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.bootstrap import paired_delta
from marginalia.operators.candidates import SELECTORS, select
from marginalia.operators.chunking import chunk_books
from marginalia.operators.context import hard_budget, merge_intervals, overlap_join
from marginalia.operators.retrieval import top_by
from marginalia.operators.ranks import range_running_sum
from marginalia.session import materialize, table


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per validation result: the one loaded last."""
    return table(spark, sf_dir, "validation_results").groupBy(F.col("result_id").alias("book")).agg(F.max_by("pages", "loaded_at").alias("pages"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").filter("rank >= 1 AND query_id IS NOT NULL").withColumn("retriever", F.lower(F.trim("retriever"))).groupBy("hit_id").agg(F.max_by(F.struct("query_id", "retriever", "rank", "candidate_id", "book_id", "pdf_pages", "text", "matches_gold", "chapter_title", "section_title"), F.struct("loaded_at", "rank", "candidate_id")).alias("h")).select("hit_id", "h.*")


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_books(_books(spark, sf_dir), "fixed")


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_books(_books(spark, sf_dir), "structured")


def _selection(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(_hits(spark, sf_dir), name, 8)

    return run


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits of every query within 60 words."""
    h = _hits(spark, sf_dir).groupBy("query_id", "candidate_id").agg(F.min("rank").alias("rank"), F.min("text").alias("text"))
    order = [F.col("rank"), F.col("candidate_id")]
    packed = hard_budget(top_by(h, "query_id", order, 5, "place"), "query_id", [F.col("place")], "text", 60)
    return packed.select("query_id", "place", "kept", "truncated", "text")


def joined_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of a book joined to the one before, without words both have. Places are counted without the texts, then neighbours are joined by place."""
    p = table(spark, sf_dir, "text_pieces").groupBy("piece_id").agg(F.max_by(F.struct("book_id", "pdf_page_number", "text"), F.struct("loaded_at", "text")).alias("p")).select("piece_id", "p.*").filter("book_id IS NOT NULL AND text IS NOT NULL")
    p = materialize(p)
    place = range_running_sum(p.select("book_id", "pdf_page_number", "piece_id", F.lit(1).cast("long").alias("one")), ["book_id"], ["pdf_page_number", "piece_id"], "one", "place")
    placed = p.select("piece_id", "text").join(place.select("piece_id", "book_id", "place"), "piece_id")
    before = placed.select("book_id", (F.col("place") + 1).alias("place"), F.col("text").alias("before"))
    return placed.join(before, ["book_id", "place"]).select("piece_id", F.length(overlap_join(F.col("before"), F.col("text"))).alias("n"))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive pages that the chunk hits of a book cover."""
    h = table(spark, sf_dir, "candidates").filter("unit_type = 'chunk' AND book_id IS NOT NULL AND size(pdf_pages) > 0").select("book_id", F.array_min("pdf_pages").alias("first"), (F.array_max("pdf_pages") + 1).alias("last")).distinct()
    return merge_intervals(h, ["book_id"], "first", "last")


def retriever_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks of every retriever against page_bm25 on the queries both answered, by book series."""
    h = _hits(spark, sf_dir)
    rr = h.groupBy("query_id", "retriever").agg(F.coalesce(F.max(F.when(F.col("matches_gold"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.min(F.regexp_replace(F.coalesce("book_id", F.lit("none")), r"_\d+$", "")).alias("stratum"))
    base = rr.filter("retriever = 'page_bm25'").select("query_id", F.col("rr").alias("base"), "stratum")
    pairs = rr.filter("retriever <> 'page_bm25'").drop("stratum").join(base, "query_id").groupBy("retriever", "stratum", F.round(F.col("rr") - F.col("base"), 9).alias("delta")).agg(F.count("*").alias("n"))
    return paired_delta(pairs, "retriever")


QUERIES = {f.__name__: f for f in (fixed_chunks, structured_chunks, context_budget, joined_pieces, page_coverage, retriever_deltas)} | {f"evidence_{name}": _selection(name) for name in SELECTORS}
SQL = {
    "context_budget": r"""WITH h AS (SELECT query_id, candidate_id, min(rank) AS rank, min(text) AS text FROM candidates WHERE rank >= 1 AND query_id IS NOT NULL GROUP BY ALL),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, candidate_id) AS INTEGER) AS place, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM h),
s AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t WHERE place <= 5)
SELECT query_id, place, CAST(least(len(w), 60 - b) AS INTEGER) AS kept, least(len(w), 60 - b) < len(w) AS truncated, array_to_string(w[1:CAST(60 - b AS BIGINT)], ' ') AS text FROM s WHERE least(len(w), 60 - b) > 0""",
    "page_coverage": """WITH h AS (SELECT DISTINCT book_id, list_min(pdf_pages) AS first, list_max(pdf_pages) + 1 AS last FROM candidates WHERE unit_type = 'chunk' AND book_id IS NOT NULL AND len(pdf_pages) > 0),
m AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY book_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY book_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT book_id, min(first) AS first, max(last) AS last FROM r GROUP BY book_id, run""",
}

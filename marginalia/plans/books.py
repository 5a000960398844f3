"""Queries over whole books: signals of a textbook, the chapter map, searchable pages, and pages as a prior of their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import LATIN_WORD, let
from marginalia.operators.blocks import split_blocks
from marginalia.operators.retrieval import RRF_K, top_by
from marginalia.session import table

# What tells a textbook from a paper or a report, and how much of it.
CONTENTS = r"(?i)\b(?:table of contents|contents|index)\b"
CHAPTER = r"(?i)\b(?:chapter|unit|lesson)\s*[-:]?\s*(\d{1,3})?\b"
EXERCISE = r"(?i)\b(exercises?|review questions?|learning objectives?|learning outcomes?|activities|worked examples?|summary|check your progress|think and discuss)\b"
PAPER = r"(?is)\babstract\b.*\b(?:methods?|methodology)\b.*\bresults?\b"
REPORT = r"(?is)\bexecutive summary\b.*\bfindings\b"
REFERENCES = r"(?im)^\s*references\s*$"
LEAST_POSITIVE, LOOKED_AT = 2, 50_000


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per validation result, the one loaded last, with its page texts in order."""
    r = table(spark, sf_dir, "validation_results").groupBy("result_id").agg(F.max_by("pages", "loaded_at").alias("pages"))
    texts = F.transform(F.coalesce("pages", F.array().cast(r.schema["pages"].dataType)), lambda p: F.coalesce(p["cleaned_text"], F.lit("")))
    return r.select("result_id", "pages", texts.alias("texts"))


def textbook_signals(texts: Column) -> Column:
    """STRUCT of the observed signals of a book's page texts, and whether they make a textbook: two positive ones and no negative one."""
    whole = F.array_join(texts, "\n")
    beginning = F.array_join(F.slice(texts, F.lit(1), F.greatest(F.lit(5), F.floor(F.size(texts) / 8).cast("int"))), "\n")

    def signals(text: Column) -> Column:
        head = F.substring(text, 1, LOOKED_AT)
        found = {
            "contents": beginning.rlike(CONTENTS), "chapters": F.regexp_count(text, F.lit(CHAPTER)) >= 2, "exercises": F.regexp_count(text, F.lit(EXERCISE)) >= 3,
            "paper": head.rlike(PAPER) & text.rlike(REFERENCES), "report": head.rlike(REPORT),
        }
        positive = sum((found[k].cast("int") for k in ("contents", "chapters", "exercises")), F.lit(0))
        return F.struct(*[v.alias(k) for k, v in found.items()], ((positive >= LEAST_POSITIVE) & ~found["paper"] & ~found["report"]).alias("textbook"))

    return let(whole, signals)


def textbook_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("result_id", textbook_signals(F.col("texts")).alias("s")).select("result_id", "s.*")


def _meaningful(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(LATIN_WORD), F.lit(0)), lambda w: F.length(w) > 3))


def chapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of each result in page order: first and last page, printed page of the first one, and whether its page confirms the title.

    A chapter ends before the next one begins, the last one with the book. Printed pages
    count from the first chapter. A page confirms a title with half of its words among
    its first 1,800 characters.
    """
    p = _books(spark, sf_dir).select("result_id", F.explode("pages").alias("p")).select("result_id", "p.pdf_page_number", "p.chapter_number", "p.chapter_title", "p.cleaned_text").filter("pdf_page_number IS NOT NULL")
    last = p.groupBy("result_id").agg(F.max("pdf_page_number").alias("pages"))
    starts = p.filter("chapter_number IS NOT NULL").groupBy("result_id", "chapter_number").agg(F.min(F.struct("pdf_page_number", F.coalesce("chapter_title", F.lit("")).alias("title"), F.coalesce("cleaned_text", F.lit("")).alias("text"))).alias("s")).select("result_id", "chapter_number", "s.*")
    title = _meaningful(F.col("title"))
    shared = F.size(F.array_intersect(title, _meaningful(F.substring("text", 1, 1800))))
    w = Window.partitionBy("result_id").orderBy("pdf_page_number", "chapter_number")  # a book has few chapters
    first = F.min("pdf_page_number").over(Window.partitionBy("result_id"))
    m = starts.select("result_id", "chapter_number", F.col("pdf_page_number").alias("first_page"), (F.lead("pdf_page_number").over(w) - 1).alias("_end"), (F.col("pdf_page_number") - first + 1).alias("printed_first"), ((F.size(title) > 0) & (shared >= F.greatest(F.lit(1), F.floor(F.size(title) / 2)))).alias("confirmed"))
    return m.join(last, "result_id").select("result_id", "chapter_number", "first_page", F.coalesce("_end", "pages").alias("last_page"), "printed_first", "confirmed")


def searchable_by_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and searchable pages of each result: those with text from the first chapter on."""
    b = _books(spark, sf_dir)
    start = F.array_min(F.transform(F.filter("pages", lambda p: p["chapter_number"].isNotNull()), lambda p: p["pdf_page_number"]))
    has = F.filter("pages", lambda p: (p["pdf_page_number"] >= start) & p["cleaned_text"].rlike(r"\S"))
    return b.select("result_id", F.coalesce(F.greatest(F.size("pages"), F.lit(0)), F.lit(0)).alias("n_pages"), F.greatest(F.coalesce(F.size(has), F.lit(0)), F.lit(0)).alias("searchable"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page, wrapped lines joined, with their kind."""
    p = _books(spark, sf_dir).select("result_id", F.posexplode("pages").alias("i", "p")).select("result_id", "i", "p.cleaned_text", "p.section_title", "p.has_table", "p.has_equation_like_text")
    return split_blocks(p, ["result_id", "i"])


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and pages of each query with their best ranks."""
    h = table(spark, sf_dir, "candidates").filter("rank >= 1 AND query_id IS NOT NULL AND book_id IS NOT NULL")
    best = lambda kind, *keys: h.filter(F.col("unit_type") == kind).select("query_id", "book_id", "candidate_id", F.explode("pdf_pages").alias("page"), "rank").groupBy(*keys).agg(F.min("rank").alias("rank"))
    return best("chunk", "query_id", "book_id", "candidate_id", "page"), best("page", "query_id", "book_id", "page")


def parent_page_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks on any of the three best pages of a query only."""
    chunks, pages = _ranked(spark, sf_dir)
    top = top_by(pages, "query_id", [F.col("rank"), F.col("book_id"), F.col("page")], 3, "k").select("query_id", "book_id", "page")
    kept = chunks.join(top, ["query_id", "book_id", "page"], "left_semi").groupBy("query_id", "candidate_id").agg(F.min("rank").alias("rank"))
    return top_by(kept, "query_id", [F.col("rank"), F.col("candidate_id")], 5, "place")


def page_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, their rank fused with that of their best page; a chunk without a ranked page keeps its own part."""
    chunks, pages = _ranked(spark, sf_dir)
    own = chunks.groupBy("query_id", "candidate_id").agg(F.min("rank").alias("own"))
    lifted = chunks.join(pages.withColumnRenamed("rank", "page_rank"), ["query_id", "book_id", "page"]).groupBy("query_id", "candidate_id").agg(F.min("page_rank").alias("prior"))
    s = own.join(lifted, ["query_id", "candidate_id"], "left").select("query_id", "candidate_id", F.round(1.0 / (RRF_K + F.col("own")) + F.coalesce(1.0 / (RRF_K + F.col("prior")), F.lit(0.0)), 9).alias("score"))
    return top_by(s, "query_id", [F.desc("score"), F.col("candidate_id")], 5, "place")


QUERIES = {f.__name__: f for f in (textbook_gate, chapter_map, searchable_by_result, page_blocks, block_kinds, parent_page_children, page_prior)}

_LATEST = "l AS (SELECT * FROM validation_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1)"
_TEXTS = "t AS (SELECT result_id, pages, list_transform(coalesce(pages, []), lambda p: coalesce(p.cleaned_text, '')) AS ts FROM l)"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[A-Za-z]+(?:[''’][A-Za-z]+)?'), lambda w: length(w) > 3))"
_RANKED = """WITH h AS (SELECT query_id, book_id, candidate_id, unit_type, unnest(pdf_pages) AS page, rank FROM candidates WHERE rank >= 1 AND query_id IS NOT NULL AND book_id IS NOT NULL),
c AS (SELECT query_id, book_id, candidate_id, page, min(rank) AS rank FROM h WHERE unit_type = 'chunk' GROUP BY ALL), p AS (SELECT query_id, book_id, page, min(rank) AS rank FROM h WHERE unit_type = 'page' GROUP BY ALL)
"""
SQL = {
    "textbook_gate": f"WITH {_LATEST}, {_TEXTS}" + r""", w AS (SELECT result_id, array_to_string(ts, chr(10)) AS w, array_to_string(ts[1:greatest(5, len(ts) // 8)], chr(10)) AS b FROM t),
s AS (SELECT result_id, regexp_matches(b, '(?i)\b(?:table of contents|contents|index)\b') AS contents, len(regexp_extract_all(w, '(?i)\b(?:chapter|unit|lesson)\s*[-:]?\s*(\d{1,3})?\b')) >= 2 AS chapters,
len(regexp_extract_all(w, '(?i)\b(exercises?|review questions?|learning objectives?|learning outcomes?|activities|worked examples?|summary|check your progress|think and discuss)\b')) >= 3 AS exercises,
regexp_matches(left(w, 50000), '(?is)\babstract\b.*\b(?:methods?|methodology)\b.*\bresults?\b') AND regexp_matches(w, '(?im)^\s*references\s*$') AS paper, regexp_matches(left(w, 50000), '(?is)\bexecutive summary\b.*\bfindings\b') AS report FROM w)
SELECT *, CAST(contents AS INTEGER) + CAST(chapters AS INTEGER) + CAST(exercises AS INTEGER) >= 2 AND NOT paper AND NOT report AS textbook FROM s""",
    "chapter_map": f"WITH {_LATEST}, p AS (SELECT result_id, u.* FROM (SELECT result_id, unnest(pages) AS u FROM l) WHERE u.pdf_page_number IS NOT NULL)" + f""",
s AS (SELECT result_id, chapter_number, pdf_page_number AS f, {_WORDS.format("coalesce(chapter_title, '')")} AS t, {_WORDS.format("left(coalesce(cleaned_text, ''), 1800)")} AS w FROM p WHERE chapter_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id, chapter_number ORDER BY pdf_page_number, coalesce(chapter_title, ''), coalesce(cleaned_text, '')) = 1)
SELECT result_id, chapter_number, f AS first_page, coalesce(lead(f) OVER (PARTITION BY result_id ORDER BY f, chapter_number) - 1, (SELECT max(pdf_page_number) FROM p WHERE p.result_id = s.result_id)) AS last_page, f - min(f) OVER (PARTITION BY result_id) + 1 AS printed_first, len(t) > 0 AND len(list_intersect(t, w)) >= greatest(1, len(t) // 2) AS confirmed FROM s""",
    "searchable_by_result": f"WITH {_LATEST}, s AS (SELECT result_id, pages, list_min(list_transform(list_filter(pages, lambda p: p.chapter_number IS NOT NULL), lambda p: p.pdf_page_number)) AS start FROM l)" + r"""
SELECT result_id, CAST(coalesce(len(pages), 0) AS INTEGER) AS n_pages, CAST(coalesce(len(list_filter(pages, lambda p: p.pdf_page_number >= start AND regexp_matches(p.cleaned_text, '\S'))), 0) AS INTEGER) AS searchable FROM s""",
    "parent_page_children": _RANKED + """, t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, book_id, page) <= 3), k AS (SELECT query_id, candidate_id, min(c.rank) AS rank FROM c SEMI JOIN t USING (query_id, book_id, page) GROUP BY ALL)
SELECT *, CAST(row_number() OVER w AS INTEGER) AS place FROM k WINDOW w AS (PARTITION BY query_id ORDER BY rank, candidate_id) QUALIFY row_number() OVER w <= 5""",
    "page_prior": _RANKED + """, k AS (SELECT query_id, candidate_id, min(c.rank) AS own, min(p.rank) AS prior FROM c LEFT JOIN p USING (query_id, book_id, page) GROUP BY ALL), s AS (SELECT query_id, candidate_id, round(1.0::DOUBLE / (60 + own) + coalesce(1.0::DOUBLE / (60 + prior), 0), 9) AS score FROM k)
SELECT *, CAST(row_number() OVER w AS INTEGER) AS place FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, candidate_id) QUALIFY row_number() OVER w <= 5""",
}

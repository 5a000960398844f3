"""Queries over page structure: chapter lookup, parents, neighbours, specialist lines, spans and token overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators.candidates import words
from marginalia.operators.retrieval import RRF_K, top_by
from marginalia.session import table

# What makes a line an equation or a figure caption.
FORMULA_LINE = r"(?i)[=+\-/×÷Ωµ]|\b(formula|equation|volt|ampere|ohm|watt|focal|resistance|current|power|distance|proportional|balanced)\b"
CAPTION_LINE = r"(?i)\b(fig(?:ure)?\.?\s*-?\s*\d+|diagram|shown in fig)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "validation_results").groupBy("result_id").agg(F.max_by("pages", "loaded_at").alias("pages"))
    return r.select("result_id", F.posexplode("pages").alias("i", "p")).select("result_id", "i", "p.*")


_PAGES = "WITH p AS (SELECT result_id, i - 1 AS i, u.* FROM (SELECT result_id, unnest(pages) AS u, generate_subscripts(pages, 1) AS i FROM (SELECT * FROM validation_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1)))\n"


def chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the chapter that starts at or last before it: one sorted pass instead of a range join."""
    p = _pages(spark, sf_dir).filter("pdf_page_number IS NOT NULL")
    starts = p.filter("chapter_number IS NOT NULL").groupBy("result_id", "chapter_number").agg(F.min("pdf_page_number").alias("pdf_page_number"))
    marks = starts.groupBy("result_id", "pdf_page_number").agg(F.max("chapter_number").alias("mark"))
    pages = p.select("result_id", "pdf_page_number").distinct().join(marks, ["result_id", "pdf_page_number"], "left")
    last = F.last("mark", ignorenulls=True).over(Window.partitionBy("result_id").orderBy("pdf_page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pages.select("result_id", "pdf_page_number", last.alias("chapter"))


def marked_lines(pages: DataFrame, pattern: str, radius: int) -> DataFrame:
    """(keys, text) of the non-blank lines that match, or stand within `radius` lines of one that does."""
    lines = F.filter(F.transform(F.split("cleaned_text", "\n"), X.collapse), lambda x: x != "")
    each = pages.select("result_id", "i", F.posexplode(lines).alias("no", "line")).withColumn("hit", F.col("line").rlike(pattern).cast("int"))
    near = F.max("hit").over(Window.partitionBy("result_id", "i").orderBy("no").rowsBetween(-radius, radius))
    kept = each.withColumn("near", near).filter("near = 1")
    return kept.groupBy("result_id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(_pages(spark, sf_dir), FORMULA_LINE, 1)


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(_pages(spark, sf_dir), CAPTION_LINE, 2)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "candidates").filter("rank >= 1 AND query_id IS NOT NULL")
    return h.groupBy("query_id", "candidate_id").agg(F.min("rank").alias("rank"), F.min("book_id").alias("book_id"), F.min(F.coalesce("chapter_title", F.lit(""))).alias("chapter"), F.min(F.coalesce("section_title", F.lit(""))).alias("section"))


_HITS = "WITH h AS (SELECT query_id, candidate_id, min(rank) AS rank, min(book_id) AS book_id, min(coalesce(chapter_title, '')) AS chapter, min(coalesce(section_title, '')) AS section FROM candidates WHERE rank >= 1 AND query_id IS NOT NULL GROUP BY ALL)\n"


def parent_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits ranked by their own place and, at half and quarter weight, that of their section and chapter."""
    h = _hits(spark, sf_dir)

    def places(keys: list[str], out: str) -> DataFrame:
        best = h.groupBy("query_id", *keys).agg(F.min("rank").alias("r"))
        return best.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy("r", *keys))).drop("r")

    j = h.join(places(["candidate_id"], "a"), ["query_id", "candidate_id"]).join(places(["chapter", "section"], "b"), ["query_id", "chapter", "section"]).join(places(["chapter"], "c"), ["query_id", "chapter"])
    s = j.select("query_id", "candidate_id", F.round(1.0 / (RRF_K + F.col("a")) + 0.5 / (RRF_K + F.col("b")) + 0.25 / (RRF_K + F.col("c")), 9).alias("score"))
    return top_by(s, "query_id", [F.desc("score"), F.col("candidate_id")], 5, "place")


def chapter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query's eight best sections within its three best chapters."""
    h = _hits(spark, sf_dir)
    return top_by(cascade(h, 3, 8).select("query_id", "candidate_id", "rank"), "query_id", [F.col("rank"), F.col("candidate_id")], 5, "place")


def cascade(hits: DataFrame, chapters: int, sections: int) -> DataFrame:
    """The hits (query_id, chapter, section, rank, ..) of the best sections within the best chapters of each query; a parent is as good as its best hit."""

    def best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        return top_by(df.groupBy("query_id", *keys).agg(F.min("rank").alias("r")), "query_id", [F.col("r"), *map(F.col, keys)], k, "k").select("query_id", *keys)

    inside = hits.join(best(hits, ["chapter"], chapters), ["query_id", "chapter"], "left_semi")
    return inside.join(best(inside, ["chapter", "section"], sections), ["query_id", "chapter", "section"], "left_semi")


def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit followed by the units before and after it in its document; the first mention of a unit stands.

    Neighbours are units that exist: those any hit names. Links to others are dropped.
    """
    hits = table(spark, sf_dir, "candidates").filter(F.col("candidate_id").rlike(r":\d+$"))
    stem, no = F.regexp_extract("candidate_id", r"^(.*:)\d+$", 1), F.regexp_extract("candidate_id", r":(\d+)$", 1).cast("int")
    units = hits.groupBy(stem.alias("stem"), no.alias("n")).agg(F.min("candidate_id").alias("unit"))
    h = _hits(spark, sf_dir).filter(F.col("candidate_id").rlike(r":\d+$")).select("query_id", "rank", "candidate_id", stem.alias("stem"), no.alias("no"))
    e = h.select("query_id", "rank", "candidate_id", "stem", "no", F.posexplode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("pos", "step")).withColumn("n", F.col("no") + F.col("step"))
    first = e.join(units, ["stem", "n"]).groupBy("query_id", "unit").agg(F.min(F.struct("rank", "candidate_id", "pos")).alias("k"))
    return top_by(first.select("query_id", "unit", "k"), "query_id", [F.col("k"), F.col("unit")], 5, "place").select("query_id", "unit", "place")


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset token overlap of query and hit text: precision, recall and F1; an empty side scores 0."""
    h = table(spark, sf_dir, "candidates").select("hit_id", "query_text", "text").dropDuplicates(["hit_id"])
    side = lambda c, flag: F.transform(F.coalesce(X.tokens(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(flag).alias("q")))
    each = h.select("hit_id", F.explode(F.concat(side("query_text", 1), side("text", 0))).alias("x")).groupBy("hit_id", "x.t").agg(F.sum("x.q").alias("q"), F.sum(1 - F.col("x.q")).alias("d"))
    s = each.groupBy("hit_id").agg(F.sum("q").alias("q"), F.sum("d").alias("d"), F.sum(F.least("q", "d")).alias("both"))
    return s.select("hit_id", F.round(F.coalesce(F.try_divide(2.0 * F.col("both"), F.col("q") + F.col("d")), F.lit(0.0)), 6).alias("f1"))


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of consecutive tokens two lists share."""
    row: dict[int, int] = {}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    best = 0
    for w in a:
        row = {j: row.get(j - 1, 0) + 1 for j in places.get(w, ())}
        best = max(best, max(row.values(), default=0))
    return best


def span_coverage(df: DataFrame, key: str, span: Column, text: Column) -> DataFrame:
    """(key, coverage): longest contiguous share of the span's tokens found in the text; 0 where either is empty."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, t in zip(b.column("_s").to_pylist(), b.column("_t").to_pylist()):
                gold = words(s)
                out.append(longest_common_run(gold, words(t)) / len(gold) if gold else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.float64())], names=[key, "coverage"])

    return df.select(key, span.alias("_s"), text.alias("_t")).mapInArrow(run, f"{key} {kind}, coverage double")


def hit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "candidates").select("hit_id", "query_text", "text").dropDuplicates(["hit_id"])
    return span_coverage(h, "hit_id", F.col("query_text"), F.col("text"))


QUERIES = {f.__name__: f for f in (chapter_lookup, formula_lines, caption_lines, parent_fusion, chapter_cascade, neighbour_expansion, token_f1, hit_coverage)}


def _lines_sql(pattern: str, radius: int) -> str:
    return _PAGES + rf""", l AS (SELECT result_id, i, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT result_id, i, list_filter(list_transform(string_split(cleaned_text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM p WHERE cleaned_text IS NOT NULL)),
n AS (SELECT *, max(CASE WHEN regexp_matches(line, '{pattern}') THEN 1 ELSE 0 END) OVER (PARTITION BY result_id, i ORDER BY no ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS near FROM l)
SELECT result_id, CAST(i AS INTEGER) AS i, string_agg(line, chr(10) ORDER BY no) AS lines FROM n WHERE near = 1 GROUP BY ALL"""


_TOK = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+(?:[.''-][A-Za-z0-9]+)*')"
SQL = {
    "chapter_lookup": _PAGES + """, s AS (SELECT result_id, chapter_number, min(pdf_page_number) AS start FROM p WHERE chapter_number IS NOT NULL AND pdf_page_number IS NOT NULL GROUP BY ALL),
m AS (SELECT result_id, start, max(chapter_number) AS chapter FROM s GROUP BY ALL), d AS (SELECT DISTINCT result_id, pdf_page_number FROM p WHERE pdf_page_number IS NOT NULL)
SELECT d.result_id, d.pdf_page_number, m.chapter FROM d ASOF LEFT JOIN m ON d.result_id = m.result_id AND d.pdf_page_number >= m.start""",
    "formula_lines": _lines_sql(FORMULA_LINE, 1),
    "caption_lines": _lines_sql(CAPTION_LINE, 2),
    "parent_fusion": _HITS + """, a AS (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, candidate_id) AS a FROM h),
b AS (SELECT query_id, chapter, section, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chapter, section) AS b FROM h GROUP BY query_id, chapter, section),
c AS (SELECT query_id, chapter, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chapter) AS c FROM h GROUP BY query_id, chapter),
s AS (SELECT query_id, candidate_id, round(1.0::DOUBLE / (60 + a) + 0.5::DOUBLE / (60 + b) + 0.25::DOUBLE / (60 + c), 9) AS score FROM h JOIN a USING (query_id, candidate_id) JOIN b USING (query_id, chapter, section) JOIN c USING (query_id, chapter))
SELECT *, CAST(row_number() OVER w AS INTEGER) AS place FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, candidate_id) QUALIFY row_number() OVER w <= 5""",
    "chapter_cascade": _HITS + """, c AS (SELECT query_id, chapter FROM h GROUP BY query_id, chapter QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chapter) <= 3),
i AS (SELECT * FROM h SEMI JOIN c USING (query_id, chapter)), s AS (SELECT query_id, chapter, section FROM i GROUP BY query_id, chapter, section QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chapter, section) <= 8)
SELECT query_id, candidate_id, rank, CAST(row_number() OVER w AS INTEGER) AS place FROM i SEMI JOIN s USING (query_id, chapter, section) WINDOW w AS (PARTITION BY query_id ORDER BY rank, candidate_id) QUALIFY row_number() OVER w <= 5""",
    "neighbour_expansion": _HITS + r""", n AS (SELECT regexp_extract(candidate_id, '^(.*:)\d+$', 1) AS stem, CAST(regexp_extract(candidate_id, ':(\d+)$', 1) AS INTEGER) AS n, min(candidate_id) AS unit FROM candidates WHERE regexp_matches(candidate_id, ':\d+$') GROUP BY 1, 2),
e AS (SELECT query_id, rank, candidate_id, unnest([0, 1, 2]) AS pos, unnest([0, -1, 1]) AS step FROM h WHERE regexp_matches(candidate_id, ':\d+$')),
u AS (SELECT query_id, rank, candidate_id, pos, unit FROM e JOIN n ON n.stem = regexp_extract(candidate_id, '^(.*:)\d+$', 1) AND n.n = CAST(regexp_extract(candidate_id, ':(\d+)$', 1) AS INTEGER) + step),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, unit ORDER BY rank, candidate_id, pos) = 1)
SELECT query_id, unit, CAST(row_number() OVER w AS INTEGER) AS place FROM f WINDOW w AS (PARTITION BY query_id ORDER BY rank, candidate_id, pos, unit) QUALIFY row_number() OVER w <= 5""",
    "token_f1": f"""WITH h AS (SELECT DISTINCT hit_id, query_text, text FROM candidates), e AS (SELECT hit_id, lower(unnest({_TOK.format('query_text')})) AS t, 1 AS q FROM h UNION ALL SELECT hit_id, lower(unnest({_TOK.format('text')})), 0 FROM h),
c AS (SELECT hit_id, t, sum(q) AS q, sum(1 - q) AS d FROM e GROUP BY ALL) SELECT hit_id, round(coalesce(2.0::DOUBLE * sum(least(q, d)) / sum(q + d), 0), 6) AS f1 FROM c GROUP BY hit_id""",
}

"""Queries over specialist routing and representations, evidence windows, and texts with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as P
from marginalia.functions import specialists as S
from marginalia.functions import text as X
from marginalia.operators.ranks import range_running_sum
from marginalia.operators.retrieval import top_by
from marginalia.session import materialize, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "validation_results").groupBy("result_id").agg(F.max_by("pages", "loaded_at").alias("pages"))
    return r.select("result_id", F.posexplode("pages").alias("i", "p")).select("result_id", "i", F.col("p.cleaned_text").alias("text")).filter("text IS NOT NULL")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").filter("query_text IS NOT NULL").select(F.lower(X.collapse(F.col("query_text"))).alias("query")).distinct()


def specialist_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct query texts per combination of activated branches, first and last version."""
    flags = [S.activated(b, F.col("query"), v).alias(f"{b}_{v}") for b in ("formula", "table", "visual") for v in ("v1", "v3")]
    return _queries(spark, sf_dir).select(*flags).groupBy(*[f"{b}_{v}" for b in ("formula", "table", "visual") for v in ("v1", "v3")]).agg(F.count("*").alias("queries"))


def formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("result_id", "i", S.formula_text(F.col("text")).alias("formula"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("result_id", "i", F.length(S.table_text(F.col("text"), "flat")).alias("flat"), S.table_text(F.col("text"), "rows").alias("rows"))


def table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("result_id", "i", S.table_text(F.col("text"), "pairs").alias("pairs"))


def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit's text around the first query word of more than four letters."""
    h = _latest_hits(spark, sf_dir)
    anchor = F.get(F.filter(X.tokens("query_text"), lambda t: F.length(t) > 4), F.lit(0))
    return h.withColumn("anchor", anchor).filter("anchor IS NOT NULL AND text IS NOT NULL").select("hit_id", S.evidence_window(F.col("text"), F.col("anchor")).alias("around")).filter("around IS NOT NULL")


def _latest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["query_id", "query_text", "retriever", "rank", "candidate_id", "text", "matches_gold", "section_title"]
    return table(spark, sf_dir, "candidates").groupBy("hit_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "rank", "candidate_id")).alias("h")).select("hit_id", "h.*")


_HITS_SQL = "h AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC, rank DESC NULLS LAST, candidate_id DESC NULLS LAST) = 1)"


def provenance_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece joined to the next one of its book, cut from the middle of the one to the middle of the other: the source places that remain, and whether they hold the text."""
    p = table(spark, sf_dir, "text_pieces").groupBy("piece_id").agg(F.max_by(F.struct("book_id", "text"), F.struct("loaded_at", "text")).alias("p")).select("piece_id", "p.*").filter("book_id IS NOT NULL AND length(text) > 0")
    p = materialize(p)
    place = range_running_sum(p.select("book_id", "piece_id", F.lit(1).cast("long").alias("one")), ["book_id"], ["piece_id"], "one", "place")
    a = p.select("piece_id", "text").join(place.select("piece_id", "book_id", "place"), "piece_id")
    b = a.select("book_id", (F.col("place") - 1).alias("place"), F.col("piece_id").alias("next_id"), F.col("text").alias("next_text"))
    both = P.join(P.whole_unit(F.col("book_id"), F.col("piece_id"), F.col("text")), P.whole_unit(F.col("book_id"), F.col("next_id"), F.col("next_text")))
    start = F.floor(F.length("text") / 2).cast("int")
    end = F.length("text") + 1 + F.floor(F.length("next_text") / 2).cast("int")
    m = a.join(b, ["book_id", "place"]).withColumn("m", both).withColumn("m", P.cut(F.col("m"), start, end))
    units = F.create_map(F.col("piece_id").cast("string"), "text", F.col("next_id").cast("string"), "next_text")
    e = m.select("piece_id", P.uncovered(F.col("m")).alias("uncovered"), P.matches_source(F.col("m"), units).alias("exact"), F.explode("m.spans").alias("s"))
    return e.select("piece_id", "uncovered", "exact", "s.unit_id", "s.source_start", "s.source_end", "s.text_start", "s.text_end")


def pack_units(units: DataFrame, group: str, order: list, text: str, heading: str, budget: int) -> DataFrame:
    """Units in order within `budget` words, headings included: adds kept (words), truncated and kept_chars; only the last one is cut.

    A unit whose heading alone does not fit ends the packing, as does a cut one. A group
    should hold a bounded list, as the first hits of a query.
    """
    words = lambda c: F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit(r"\S+"))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_head")).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = units.withColumns({"_n": words(text), "_head": words(heading) + 1}).withColumn("_room", (F.lit(budget) - before - F.col("_head")).cast("int"))
    s = s.withColumn("kept", F.least("_n", "_room")).filter("kept > 0").withColumn("truncated", F.col("kept") < F.col("_n"))
    kept_chars = F.length(F.expr(rf"regexp_extract(`{text}`, concat('^(?:\\s*\\S+){{0,', kept, '}}'), 0)"))
    return s.withColumn("kept_chars", kept_chars).drop("_n", "_head", "_room")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _latest_hits(spark, sf_dir).filter("rank >= 1 AND query_id IS NOT NULL").groupBy("query_id", "candidate_id").agg(F.min("rank").alias("rank"), F.min("text").alias("text"), F.min("section_title").alias("section_title"))
    best = top_by(h, "query_id", [F.col("rank"), F.col("candidate_id")], 6, "place")
    return pack_units(best, "query_id", [F.col("place")], "text", "section_title", 90)


def packed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("query_id", "place", "candidate_id", "kept", "truncated", "kept_chars")


def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query with relevant candidates: precision and recall of the packed ones, whole or cut, and whether all are there."""
    gold = _latest_hits(spark, sf_dir).filter("rank >= 1 AND query_id IS NOT NULL AND matches_gold").select("query_id", "candidate_id").distinct()
    got = _packed(spark, sf_dir).select("query_id", "candidate_id", (~F.col("truncated")).cast("int").alias("whole"))
    each = gold.withColumn("gold", F.lit(1)).join(got.withColumn("got", F.lit(1)), ["query_id", "candidate_id"], "full").na.fill(0)
    m = each.groupBy("query_id").agg(F.sum("gold").alias("n"), F.sum("got").alias("got"), F.sum(F.col("gold") * F.col("got")).alias("hit"), F.sum(F.col("gold") * F.col("whole")).alias("whole"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return m.filter("n > 0").select("query_id", ratio("hit", "got").alias("precision"), ratio("hit", "n").alias("recall"), ratio("whole", "n").alias("whole_recall"), (F.col("hit") == F.col("n")).alias("complete"))


QUERIES = {f.__name__: f for f in (specialist_routing, formula_texts, table_rows, table_pairs, evidence_windows, provenance_slices, packed_units, context_recall)}

_PAGES = "p AS (SELECT result_id, CAST(i - 1 AS INTEGER) AS i, u.cleaned_text AS text FROM (SELECT result_id, unnest(pages) AS u, generate_subscripts(pages, 1) AS i FROM (SELECT * FROM validation_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1)) WHERE u.cleaned_text IS NOT NULL)"
_FORMULA = "text"
for _a, _b in (("−", "-"), ("–", "-"), ("—", "-"), ("×", " x "), ("÷", " / "), ("→", " -> "), ("⇒", " => "), ("µ", " proportional-to "), ("Ω", " ohm Ω "), ("°C", " degree Celsius ")):
    _FORMULA = f"replace({_FORMULA}, '{_a}', '{_b}')"
_FORMULA = rf"regexp_replace(regexp_replace(regexp_replace({_FORMULA}, '(?i)\bKWH\b', 'kWh kilowatt hour', 'g'), '(\d)\s*W\b', '\1 watt W', 'g'), '(\d)\s*V\b', '\1 volt V', 'g')"
_TABLE = _PAGES + r""", l AS (SELECT result_id, i, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM p),
c AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)\btable\s*-?\s*\d+')), true), 0) AS cap FROM l),
s AS (SELECT *, CASE WHEN cap > 0 THEN ls[greatest(cap - 12, 1):cap + 1] ELSE ls[1:20] END AS near FROM c),
g AS (SELECT *, coalesce(list_filter(near, lambda x: len(string_split(x, ' ')) BETWEEN 2 AND 8 AND NOT regexp_matches(x, '[.!?]$'))[1], 'Table row') AS header FROM s),
r AS (SELECT *, list_filter(ls, lambda x: x <> header AND contains(x, ' ')) AS rs FROM g)
"""
_PACK = _HITS_SQL + r""", c AS (SELECT query_id, candidate_id, min(rank) AS rank, min(text) AS text, min(section_title) AS title FROM h WHERE rank >= 1 AND query_id IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, candidate_id) AS INTEGER) AS place, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n, 1 + len(regexp_extract_all(coalesce(title, ''), '\S+')) AS head FROM c),
f AS (SELECT *, 90 - head - coalesce(sum(n + head) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t WHERE place <= 6),
k AS (SELECT query_id, place, candidate_id, CAST(least(n, room) AS INTEGER) AS kept, room < n AS truncated, text FROM f WHERE least(n, room) > 0)
"""
SQL = {
    "specialist_routing": r"""WITH q AS (SELECT DISTINCT lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))) AS q FROM candidates WHERE query_text IS NOT NULL),
f AS (SELECT regexp_matches(q, '(?i)\b(formula|equation|law|voltage|current|resistan(?:ce|tor)|power|focal length|object distance|image distance|sign convention|pH|atom(?:s|ic)|electron|balanced|lens|mirror|reflection|refraction)\b|[=Ωµ×÷]') AS formula_v1,
regexp_matches(q, '(?i)\b(formula|equation|laws?|voltage|resistance|electric power|focal length|object distance|image distance|sign convention|balanced|equivalent resistance|parallel resistors?|stronger lenses?|shorter focus)\b|\b\d+\s*W\b|[=Ωµ×÷]') AS formula_v3,
regexp_matches(q, '(?i)\b(table|row|column|compare|differ(?:ence)?|functions?|attributed|auxins?|cytokinins?|mitosis|meiosis|chromosome(?:s)?|daughter cells?)\b') AS table_v1,
regexp_matches(q, '(?i)\b(table|row|column|auxins?|cytokinins?|mitosis|meiosis)\b|\bchromosome(?:s)?\b.*\b(daughter cells?|half)\b|\bhalf\b.*\bchromosome(?:s)?\b') AS table_v3,
regexp_matches(q, '(?i)\b(diagram|figure|fig\.?|principal rays?|ray diagram|constructed|image formation|concave lens|convex lens|myopia|short-sighted|series|parallel circuit|branches)\b') AS visual_v1 FROM q)
SELECT *, visual_v1 AS visual_v3, count(*) AS queries FROM f GROUP BY ALL""",
    "formula_texts": f"WITH {_PAGES} SELECT result_id, i, array_to_string(list_transform(list_filter(string_split({_FORMULA}, chr(10)), lambda x: regexp_matches(x, '\\S')), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)) AS formula FROM p",
    "table_rows": f"WITH {_TABLE} SELECT result_id, i, CAST(length(array_to_string(ls, ' ')) AS INTEGER) AS flat, array_to_string(list_transform(rs, lambda x: 'Header: ' || header || ' | Row: ' || x), chr(10)) AS rows FROM r",
    "table_pairs": f"WITH {_TABLE} SELECT result_id, i, array_to_string(list_transform(rs, lambda x: header || ' | Key: ' || array_to_string(string_split(x, ' ')[1:CASE WHEN len(string_split(x, ' ')) < 6 THEN 1 ELSE 2 END], ' ') || ' | Value: ' || array_to_string(string_split(x, ' ')[CASE WHEN len(string_split(x, ' ')) < 6 THEN 2 ELSE 3 END:], ' ')), chr(10)) AS pairs FROM r",
    "evidence_windows": "WITH " + _HITS_SQL + r""", a AS (SELECT hit_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, list_filter(list_transform(regexp_extract_all(query_text, '[A-Za-z0-9]+(?:[.''-][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: length(x) > 4)[1] AS anchor FROM h WHERE text IS NOT NULL),
b AS (SELECT *, strpos(lower(flat), anchor) - 1 AS pos FROM a WHERE anchor IS NOT NULL), c AS (SELECT *, greatest(0, pos - 95) AS s0, least(length(flat), pos + length(anchor) + 190) AS e0 FROM b WHERE pos >= 0),
d AS (SELECT *, CASE WHEN s0 > 0 AND strpos(flat[s0 + 1:], ' ') > 0 THEN s0 + strpos(flat[s0 + 1:], ' ') ELSE s0 END AS s FROM c)
SELECT hit_id, CASE WHEN e0 < length(flat) THEN regexp_replace(flat[s + 1:e0], ' [^ ]*$', '') ELSE flat[s + 1:e0] END AS around FROM d""",
    "provenance_slices": """WITH p AS (SELECT piece_id, book_id, text FROM text_pieces QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY loaded_at DESC, text DESC NULLS LAST) = 1),
n AS (SELECT piece_id, length(text) AS a, lead(piece_id) OVER w AS next_id, lead(length(text)) OVER w AS b FROM p WHERE book_id IS NOT NULL AND length(text) > 0 WINDOW w AS (PARTITION BY book_id ORDER BY piece_id)), m AS (SELECT *, a - a // 2 AS k FROM n WHERE next_id IS NOT NULL)
SELECT piece_id, 0 AS uncovered, true AS exact, CAST(piece_id AS VARCHAR) AS unit_id, CAST(a // 2 AS INTEGER) AS source_start, CAST(a AS INTEGER) AS source_end, 0 AS text_start, CAST(k AS INTEGER) AS text_end FROM m
UNION ALL SELECT piece_id, 0, true, CAST(next_id AS VARCHAR), 0, CAST(b // 2 AS INTEGER), CAST(k + 1 AS INTEGER), CAST(k + 1 + b // 2 AS INTEGER) FROM m WHERE b // 2 > 0""",
    "packed_units": f"WITH {_PACK} SELECT query_id, place, candidate_id, kept, truncated, CAST(length(regexp_extract(text, '^(?:\\s*\\S+){{0,' || kept || '}}')) AS INTEGER) AS kept_chars FROM k",
    "context_recall": f"""WITH {_PACK}, g AS (SELECT DISTINCT query_id, candidate_id FROM h WHERE rank >= 1 AND query_id IS NOT NULL AND matches_gold),
n AS (SELECT query_id, count(*) AS n, count(k.candidate_id) AS hit, count(*) FILTER (WHERE NOT k.truncated) AS whole FROM g LEFT JOIN k USING (query_id, candidate_id) GROUP BY query_id), o AS (SELECT query_id, count(*) AS got FROM k GROUP BY query_id)
SELECT query_id, round(coalesce(hit / nullif(got, 0), 0), 6) AS precision, round(hit / n, 6) AS recall, round(whole / n, 6) AS whole_recall, hit = n AS complete FROM n LEFT JOIN o USING (query_id)""",
}

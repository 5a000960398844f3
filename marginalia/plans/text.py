"""Queries over the scalar text functions and the document acceptance gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import queries as Q
from marginalia.functions import text as X
from marginalia.session import table

_TOKENS_SQL = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[.''-][A-Za-z0-9]+)*'), lambda x: lower(x))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "validation_results").select("result_id", F.explode("pages").alias("p")).select("result_id", "p.*").select("result_id", "pdf_page_number", F.col("cleaned_text").alias("text")).distinct()


_PAGES = "WITH p AS (SELECT DISTINCT result_id, u.pdf_page_number AS pdf_page_number, u.cleaned_text AS text FROM (SELECT result_id, unnest(pages) AS u FROM validation_results))\n"


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct")).filter("n_tokens >= 0")


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "validation_results").select("result_id", F.explode("pages").alias("p")).select("result_id", "p.pdf_page_number", "p.chapter_title", F.col("p.cleaned_text").alias("text")).distinct()
    c = p.filter("text IS NOT NULL").withColumn("cleaned", X.clean_text("text"))
    return c.select("result_id", "pdf_page_number", "cleaned", F.array_join(X.cleaning_notes(F.col("text"), F.col("cleaned"), F.col("chapter_title")), ",").alias("notes"))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _pages(spark, sf_dir).filter("text IS NOT NULL").select("result_id", "pdf_page_number", t.rlike(X.TABLE_MARK).alias("has_table"), t.rlike(X.FIGURE_MARK).alias("has_figure"), t.rlike(X.EQUATION).alias("has_equation"), X.section_title(t).alias("section_title"), F.length(t).alias("n"))


def content_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "candidates").select("hit_id", "query_text", "text").filter("query_text IS NOT NULL AND text IS NOT NULL").distinct()
    q, t = X.tokens("query_text"), X.tokens("text")
    return h.select("hit_id", F.round(X.token_recall(F.col("query_text"), F.col("text")), 6).alias("recall"), F.round(X.jaccard(F.array_distinct(q), F.array_distinct(t)), 6).alias("jaccard"), F.round(X.jaccard(F.array_distinct(q), F.array_distinct(t), 0.0), 6).alias("similarity"))


def document_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(X.shingles(X.tokens("text"))).alias("n_shingles"))


def corrupt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.corruption_reason(F.col("text")).alias("reason")).filter("reason IS NOT NULL")


def query_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "candidates").select("hit_id", "query_text", "text").filter("query_text IS NOT NULL AND text IS NOT NULL").distinct()
    return h.select("hit_id", X.snippet(F.col("text"), F.col("query_text"), 120).alias("snippet"))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "text_pieces").select("piece_id", "text").filter("text IS NOT NULL").distinct()
    return d.select("piece_id", F.posexplode(X.sentences(F.col("text"), 120)).alias("no", "sentence"))


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.word_windows(F.col("text"), 250, 200)).alias("w"))
    return d.select("doc_id", F.col("w.start").alias("start"), F.length("w.text").alias("n_chars"), F.md5("w.text").alias("digest"))


def process_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "candidates").select("query_text").filter("query_text IS NOT NULL").distinct()
    return q.select("query_text", *[Q.process(m, F.col("query_text")).alias(m) for m in Q.PROCESSORS if m != "raw"])


def query_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that fire on each distinct query text, per processor."""
    q = table(spark, sf_dir, "candidates").select("query_text").filter("query_text IS NOT NULL").distinct()
    return q.select("query_text", *[F.array_join(Q.fired(m, F.col("query_text")), ",").alias(m) for m in Q.PROCESSORS if m != "raw"])


def text_layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text metrics per validation result and the first gate it fails."""
    stripped = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    alpha, bad = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z]", "")), F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("�"), F.lit("")))
    m = _pages(spark, sf_dir).groupBy("result_id").agg(
        F.count("*").alias("pages"), F.avg((stripped >= 100).cast("double")).alias("text_page_ratio"), F.expr("percentile(length(regexp_replace(coalesce(text, ''), '^\\\\s+|\\\\s+$', '')), 0.5)").alias("median_chars"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum(alpha).alias("alpha"), F.sum(bad).alias("bad"),
    )
    size = F.greatest("chars", F.lit(1))
    code = (
        F.when(F.col("text_page_ratio") < 0.90, "scanned_or_image_only").when(F.col("median_chars") < 250, "insufficient_instructional_text")
        .when(F.col("bad") / size > 0.01, "corrupt_text_extraction").when(F.col("alpha") / size < 0.45, "corrupt_text_extraction")
    )
    return m.select("result_id", "pages", F.round("text_page_ratio", 6).alias("text_page_ratio"), "median_chars", F.round(F.col("alpha") / size, 6).alias("alpha_ratio"), F.round(F.col("bad") / size, 6).alias("bad_ratio"), code.alias("error_code"))


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common-word ratio over at most five prose pages at the quantiles of each result, and whether they are English.

    English takes 0.90 of Latin letters and 0.015 of common words. A result
    without prose pages has 0 samples and isn't English.
    """
    prose = _pages(spark, sf_dir).filter(F.regexp_count("text", F.lit(X.LATIN_WORD)) >= 40)
    w = Window.partitionBy("result_id")
    ranked = prose.withColumns({"i": F.row_number().over(w.orderBy("pdf_page_number", "text")) - 1, "n": F.count("*").over(w)})
    picks = [F.floor(F.col("n") * k / 4) for k in (0, 1, 2, 3)] + [F.col("n") - 1]
    sampled = ranked.filter(F.col("i").isin(*picks)).select("result_id", F.substring("text", 1, 6000).alias("text"))  # the reference's sample
    words = F.transform(F.regexp_extract_all("text", F.lit(X.LATIN_WORD), F.lit(0)), lambda x: F.replace(F.lower(x), F.lit("’"), F.lit("'")))
    common = F.size(F.filter(words, lambda x: x.isin(*X.ENGLISH_COMMON)))
    count = lambda kind: F.sum(F.regexp_count("text", F.lit(kind)))
    m = sampled.groupBy("result_id").agg(
        F.count("*").alias("samples"), (F.sum(common) / F.greatest(F.sum(F.size(words)), F.lit(1))).alias("ratio"),
        (count(r"[\p{IsLatin}&&\p{L}]") / F.greatest(count(r"\p{L}"), F.lit(1))).alias("latin"),
    )
    every = table(spark, sf_dir, "validation_results").select("result_id").distinct().alias("e")
    m = every.join(m.alias("m"), F.col("e.result_id").eqNullSafe(F.col("m.result_id")), "left").select("e.result_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("samples", "ratio", "latin")])
    return m.select("result_id", "samples", F.round("ratio", 6).alias("common_ratio"), ((F.col("latin") >= 0.90) & (F.col("ratio") >= 0.015)).alias("english"))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur among the first and last three lines of a result's pages."""
    key = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    lines = F.split("text", "\n")
    edge = F.array_distinct(F.transform(F.concat(F.slice(lines, 1, 3), F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3)), key))
    pages = _pages(spark, sf_dir).filter("text IS NOT NULL")
    sizes = pages.groupBy("result_id").agg(F.count("*").alias("n"))
    counts = pages.select("result_id", F.explode(edge).alias("line")).filter("length(line) BETWEEN 4 AND 180").groupBy("result_id", "line").agg(F.count("*").alias("pages"))
    return counts.join(sizes, "result_id").filter((F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.3))) & ~F.col("line").rlike(r"^\d+$")).select("result_id", "line", "pages")


def _sql_words(t: str) -> str:
    return "list_filter(string_split(trim(regexp_replace(%s, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')" % t


def _stem_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({t}, '{s}') AND length({t}) - {len(s)} >= 4 THEN left({t}, length({t}) - {len(s)})" for s in X.SUFFIXES) + f" ELSE {t} END"


def _content_sql(t: str) -> str:
    stop = ", ".join(f"'{s}'" for s in X.STOPWORDS)
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({stop})), lambda x: {_stem_sql('x')}))"


def _rewrite_sql(rules) -> str:
    q = "query_text"
    for p, to in rules:
        q = f"regexp_replace({q}, '{p}', '{to}', 'gi')"
    return q


def _extend_sql(label: str, hits: list[tuple[str, str]], distinct: bool = False) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for c, x in hits) + "], lambda x: x IS NOT NULL)"
    if distinct:  # keeps the first of each
        found = f"(SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(f) AS v, generate_subscripts(f, 1) AS i FROM (SELECT {found} AS f)) GROUP BY v))"
    return f"CASE WHEN coalesce(len({found}), 0) > 0 THEN query_text || ' {label}: ' || array_to_string({found}, ' ') ELSE query_text END"


def _fired_sql(cases: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for cond, rule in cases) + ")"


QUERIES = {
    "tokenize_documents": tokenize_documents, "clean_pages": clean_pages, "page_flags": page_flags, "content_recall": content_recall, "document_shingles": document_shingles,
    "corrupt_documents": corrupt_documents, "query_snippets": query_snippets, "split_sentences": split_sentences, "page_windows": page_windows,
    "process_queries": process_queries, "query_rules": query_rules, "text_layer_gate": text_layer_gate, "language_gate": language_gate, "running_lines": running_lines,
}
SQL = {
    "tokenize_documents": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_TOKENS_SQL.format('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "clean_pages": r"""WITH p AS (SELECT DISTINCT result_id, u.pdf_page_number AS pdf_page_number, u.chapter_title AS title, u.cleaned_text AS text FROM (SELECT result_id, unnest(pages) AS u FROM validation_results))
SELECT result_id, pdf_page_number, cleaned, array_to_string(list_filter([
  CASE WHEN contains(text, chr(65533)) THEN 'replacement_character_present_in_raw_text' END,
  CASE WHEN regexp_matches(text, '[A-Za-z]-\s*\n\s*[a-z]') THEN 'line_break_hyphenation_repaired' END,
  CASE WHEN length(title) > 0 AND (length(lower(cleaned)) - length(replace(lower(cleaned), lower(title), ''))) / length(title) > 1 THEN 'repeated_chapter_title_in_text_layer' END,
  CASE WHEN length(cleaned) < 100 THEN 'low_text_page' END], lambda x: x IS NOT NULL), ',') AS notes FROM (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(65533), ''''), '(?i)Government[''’]s Gift for Students[''’] Progress', ' ', 'g'), '(?m)^\s*CLASS\s+(?:X|10)\s*$', ' ', 'g'), '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned
  FROM p WHERE text IS NOT NULL)""",
    "page_flags": _PAGES + r"""SELECT result_id, pdf_page_number, regexp_matches(text, '(?i)\btable\s*[-:]?\s*\d+|\btabular\b') AS has_table,
  regexp_matches(text, '(?i)\b(?:fig(?:ure)?|diagram)\s*[-:]?\s*[A-Z]?\d+') AS has_figure, regexp_matches(text, '(?i)(?:[A-Za-z0-9)\]]\s*[=+−–]\s*[A-Za-z0-9(\[]|\b(?:sin|cos|tan)\s*[A-Za-zθ]|(?:^|[^\p{L}\p{N}_])[A-Z][a-z]?\s*\d{1,2}\b|\b\d+(?:\.\d+)?\s*(?:V|A|W|Ω|ohm|J|N|m/s|cm|kg)\b)') AS has_equation,
  nullif(left(trim(regexp_replace(regexp_extract(text, '(?m)^\s*((?:\d{1,2}\.){1,3}\d*\s+[^\n]{3,100})\s*$', 1), '\s+', ' ', 'g')), 160), '') AS section_title, CAST(length(text) AS INTEGER) AS n
  FROM p WHERE text IS NOT NULL""",
    "content_recall": f"""WITH h AS (SELECT DISTINCT hit_id, query_text, text FROM candidates WHERE query_text IS NOT NULL AND text IS NOT NULL),
t AS (SELECT hit_id, {_content_sql('query_text')} AS qc, {_content_sql('text')} AS tc, list_distinct({_TOKENS_SQL.format('query_text')}) AS a, list_distinct({_TOKENS_SQL.format('text')}) AS b FROM h),
n AS (SELECT *, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either FROM t)
SELECT hit_id, round(CASE WHEN len(qc) = 0 THEN 1.0 ELSE len(list_intersect(qc, tc)) / len(qc) END, 6) AS recall,
round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE shared / either END, 6) AS jaccard, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE shared / either END, 6) AS similarity FROM n""",
    "document_shingles": f"""SELECT doc_id, CAST(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))) END AS INTEGER) AS n_shingles
FROM (SELECT doc_id, {_TOKENS_SQL.format('text')} AS t FROM documents WHERE text IS NOT NULL)""",
    "corrupt_documents": r"""WITH d AS (SELECT doc_id, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '\s+') AS ws FROM d)),
g AS (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM w), r AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, w, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT * FROM (SELECT doc_id, CASE WHEN t = '' THEN 'empty_output' WHEN regexp_matches(t, '(?i)<unused\d+>') THEN 'unused_token_stream'
  WHEN length(t) - length(replace(t, chr(65533), '')) > greatest(1, length(t) // 100) THEN 'replacement_character_corruption' WHEN r.n >= 20 THEN 'repeated_token_stream' END AS reason
  FROM d LEFT JOIN r USING (doc_id)) WHERE reason IS NOT NULL""",
    "split_sentences": r"""WITH d AS (SELECT DISTINCT piece_id, text FROM text_pieces WHERE text IS NOT NULL),
s AS (SELECT piece_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, text FROM (SELECT piece_id, text, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM d)),
w AS (SELECT piece_id, text, i, k, array_to_string(string_split(s, ' ')[k:k + 119], ' ') AS sentence FROM (SELECT piece_id, text, i, s, unnest(range(1, len(string_split(s, ' ')) + 1, 120)) AS k FROM s WHERE s <> ''))
SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id, text ORDER BY i, k) - 1 AS INTEGER) AS no, sentence FROM w""",
    "page_windows": f"""WITH w AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, CAST(unnest(range(0, CAST(greatest(0, ceil((len(w) - 250) / 200)) AS BIGINT) + 1)) * 200 AS INTEGER) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, start, CAST(length(array_to_string(w[start + 1:start + 250], ' ')) AS INTEGER) AS n_chars, md5(array_to_string(w[start + 1:start + 250], ' ')) AS digest FROM s""",
    "process_queries": f"""WITH q AS (SELECT DISTINCT query_text FROM candidates WHERE query_text IS NOT NULL)
SELECT query_text, {_rewrite_sql(Q.SPELLING)} AS spelling_normalization, {_rewrite_sql(Q.GRAMMAR)} AS grammar_cleanup,
{_extend_sql('Related textbook terms', [(' AND '.join(f"contains(lower(query_text), '{t}')" for t in ts), x) for ts, x in Q.SYNONYMS], True)} AS textbook_synonym_expansion,
{_extend_sql('Expanded terms', [(f"regexp_matches(query_text, '{p}')", x) for p, x in Q.ACRONYMS])} AS acronym_expansion,
{_extend_sql('Normalized quantities', [(f"contains(lower(query_text), '{t}')", x) for t, x in Q.QUANTITIES])} AS formula_symbol_normalization FROM q""",
    "query_rules": f"""WITH q AS (SELECT DISTINCT query_text FROM candidates WHERE query_text IS NOT NULL)
SELECT query_text, {_fired_sql([(f"regexp_matches(query_text, '(?i){p}')", f"spelling:{to}") for p, to in Q.SPELLING])} AS spelling_normalization, {_fired_sql([(f"regexp_matches(query_text, '(?i){p}')", f"grammar:{to}") for p, to in Q.GRAMMAR])} AS grammar_cleanup,
{_fired_sql([(' AND '.join(f"contains(lower(query_text), '{t}')" for t in ts), "synonym:" + "+".join(ts)) for ts, _ in Q.SYNONYMS])} AS textbook_synonym_expansion, {_fired_sql([(f"regexp_matches(query_text, '{p}')", f"acronym:{x}") for p, x in Q.ACRONYMS])} AS acronym_expansion,
{_fired_sql([(f"contains(lower(query_text), '{t}')", f"quantity:{t}") for t, _ in Q.QUANTITIES])} AS formula_symbol_normalization FROM q""",
    "text_layer_gate": _PAGES + r""", m AS (SELECT result_id, count(*) AS pages, avg(CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 100 THEN 1.0 ELSE 0.0 END) AS r,
  quantile_cont(CAST(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS DOUBLE), 0.5) AS median_chars, greatest(1, sum(length(coalesce(text, '')))) AS n,
  sum(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) AS a, sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), ''))) AS b FROM p GROUP BY result_id)
SELECT result_id, pages, round(r, 6) AS text_page_ratio, median_chars, round(a / n, 6) AS alpha_ratio, round(b / n, 6) AS bad_ratio,
  CASE WHEN r < 0.9 THEN 'scanned_or_image_only' WHEN median_chars < 250 THEN 'insufficient_instructional_text' WHEN b / n > 0.01 THEN 'corrupt_text_extraction' WHEN a / n < 0.45 THEN 'corrupt_text_extraction' END AS error_code FROM m""".replace("{", "{"),
    "language_gate": _PAGES + r""", q AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)?') AS w0 FROM p WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY pdf_page_number NULLS FIRST, text) - 1 AS i, count(*) OVER (PARTITION BY result_id) AS n FROM q WHERE len(w0) >= 40),
s AS (SELECT result_id, len(regexp_extract_all(left(text, 6000), '\p{Latin}')) AS la, len(regexp_extract_all(left(text, 6000), '\p{L}')) AS le, list_transform(regexp_extract_all(left(text, 6000), '[A-Za-z]+(?:[''’][A-Za-z]+)?'), lambda x: replace(lower(x), '’', '''')) AS w FROM r WHERE i IN (0, n // 4, n * 2 // 4, n * 3 // 4, n - 1)),
m AS (SELECT result_id, count(*) AS samples, sum(len(list_filter(w, lambda x: x IN (""" + ", ".join(f"'{x}'" for x in X.ENGLISH_COMMON) + r""")))) / greatest(1, sum(len(w))) AS ratio, sum(la) / greatest(1, sum(le)) AS latin FROM s GROUP BY result_id)
SELECT result_id, coalesce(samples, 0) AS samples, round(coalesce(ratio, 0), 6) AS common_ratio, coalesce(ratio >= 0.015 AND latin >= 0.90, false) AS english FROM (SELECT DISTINCT result_id FROM validation_results) LEFT JOIN m USING (result_id)""",
    "running_lines": _PAGES + r""", l AS (SELECT result_id, pdf_page_number, text, string_split(text, chr(10)) AS ls FROM p WHERE text IS NOT NULL),
n AS (SELECT result_id, count(*) AS n FROM l GROUP BY result_id),
e AS (SELECT result_id, unnest(list_distinct(list_transform(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):len(ls)]), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))))) AS line FROM l)
SELECT result_id, line, count(*) AS pages FROM e JOIN n USING (result_id) WHERE length(line) BETWEEN 4 AND 180 AND NOT regexp_matches(line, '^\d+$') GROUP BY result_id, line, n HAVING count(*) >= greatest(3, floor(n * 0.3))""",
}

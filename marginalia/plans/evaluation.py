"""Queries over answer checks and scores, near duplicates, gold evidence, selection protocols and idempotent stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import answers as A
from marginalia.functions import text as X
from marginalia.operators.references import clean_key, parse_time
from marginalia.operators.retrieval import top_by
from marginalia.operators.sampling import disjoint_sample
from marginalia.operators.similarity import near_duplicate_sets
from marginalia.session import table


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["query_id", "query_text", "retriever", "rank", "candidate_id", "unit_type", "book_id", "pdf_pages", "textbook_pages", "text", "matches_gold", "chapter_title", "section_title"]
    return table(spark, sf_dir, "candidates").groupBy("hit_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "rank", "candidate_id")).alias("h")).select("hit_id", "h.*")


_HITS = "WITH h AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC, rank DESC NULLS LAST, candidate_id DESC NULLS LAST) = 1)"


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of hits, which cite their first page and their second printed page: whether they pass, and their errors."""
    h = _hits(spark, sf_dir).filter("candidate_id IS NOT NULL AND text IS NOT NULL")
    citation = F.struct(F.col("candidate_id").alias("evidence_id"), F.get("pdf_pages", F.lit(0)).alias("pdf_page"), F.get("textbook_pages", F.lit(1)).alias("textbook_page"))
    status = F.when(F.col("rank") >= 1, "answered").otherwise("unknown")
    raw = F.to_json(F.struct(status.alias("status"), F.col("text").alias("answer"), F.array("candidate_id").alias("selected_evidence_ids"), F.array(citation).alias("citations"), F.array().cast("array<string>").alias("missing_information")), {"ignoreNullFields": "false"})
    evidence = F.array(F.struct(F.col("candidate_id").alias("evidence_id"), F.col("pdf_pages").alias("pdf_pages"), F.col("textbook_pages").alias("textbook_pages")))
    p = h.select("hit_id", A.parse_answer(F.concat(F.lit("```json\n"), raw, F.lit("\n```")), evidence).alias("p"))
    return p.select("hit_id", "p.valid", F.array_join("p.errors", "; ").alias("errors"), "p.citations", "p.valid_citations")


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text as the predicted and section title as the wanted answer, with pages as supporting facts: overlaps and joint F1 per retriever."""
    h = _hits(spark, sf_dir)
    a = A.answer_overlap(F.coalesce("query_text", F.lit("")), F.coalesce("section_title", F.lit("")))
    first = F.coalesce(F.slice("pdf_pages", 1, 1), F.array().cast("array<int>"))
    s = h.select(F.lower(F.trim("retriever")).alias("retriever"), a.alias("a"), A.set_overlap(first, F.coalesce("pdf_pages", F.array().cast("array<int>"))).alias("s"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return s.groupBy("retriever").agg(F.count("*").alias("n"), mean("a.em", "em"), mean("a.precision", "prec"), mean("a.f1", "f1"), mean("s.recall", "support_recall"), mean("s.f1", "support_f1"), mean(A.joint_f1(F.col("a"), F.col("s")), "joint_f1"))


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each hit's text supports the query text as a claim: content words and numbers."""
    h = _hits(spark, sf_dir).filter("query_text IS NOT NULL AND text IS NOT NULL")
    return h.groupBy(F.lower(F.trim("retriever")).alias("retriever")).agg(F.count("*").alias("n"), F.count_if(A.supported(F.col("query_text"), F.col("text"), 0.3)).alias("supported"))


def near_duplicate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of query texts with a Jaccard similarity of 0.86 or more, one row per two different token sets."""
    q = table(spark, sf_dir, "candidates").filter("query_text IS NOT NULL AND query_id IS NOT NULL").groupBy(F.lower(F.trim(F.regexp_replace("query_text", r"\s+", " "))).alias("text")).agg(F.min("query_id").alias("id"))
    pairs, _ = near_duplicate_sets(q, "id", F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)), 0.86)
    return pairs.select("left_id", "right_id", F.round("similarity", 4).alias("similarity"))


def near_duplicate_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every text piece by equal words, and the number of similar classes (0.8)."""
    p = table(spark, sf_dir, "text_pieces").groupBy("piece_id").agg(F.max(F.struct("loaded_at", "text")).alias("last")).select("piece_id", F.col("last.text").alias("text")).filter(F.col("text").rlike("[A-Za-z0-9]"))
    pairs, members = near_duplicate_sets(p, "piece_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 0.8)
    links = pairs.select(F.explode(F.array("left_id", "right_id")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(links, "class_id", "left").select(F.col("id").alias("piece_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def gold_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that hold at least half of a query's distinct tokens and 0.9 of what the best one holds: the primary one and the alternatives."""
    h = _hits(spark, sf_dir).filter("query_id IS NOT NULL AND candidate_id IS NOT NULL").withColumn("q", F.array_distinct(X.tokens("query_text"))).filter("size(q) > 0")
    share = F.size(F.array_intersect("q", F.coalesce(X.tokens("text"), F.array().cast("array<string>")))) / F.size("q")
    each = h.select("query_id", "candidate_id", F.round(share, 6).alias("coverage")).groupBy("query_id", "candidate_id").agg(F.max("coverage").alias("coverage"))
    best = each.groupBy("query_id").agg(F.max("coverage").alias("best"), F.max(F.struct("coverage")).alias("_b")).drop("_b").filter("best >= 0.5")
    kept = each.join(best, "query_id").filter("coverage >= 0.5 AND coverage >= round(best * 0.9, 6)")
    return top_by(kept.select("query_id", "candidate_id", "coverage"), "query_id", [F.desc("coverage"), F.col("candidate_id")], 1 << 30, "place").withColumn("role", F.when(F.col("place") == 1, "primary").otherwise("alternative"))


def disjoint_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in hash order of which no two taken ones share a page of a book."""
    h = _hits(spark, sf_dir).filter("book_id IS NOT NULL AND size(pdf_pages) > 0")
    marks = F.transform("pdf_pages", lambda p: F.concat_ws(":", "book_id", p.cast("string")))
    key = F.sha2(F.concat_ws(":", F.lit("disjoint"), F.lit(1729), F.col("hit_id")), 256)
    return disjoint_sample(h.select("hit_id", marks.alias("marks"), key.alias("key")), "hit_id", "marks", "key").select(F.col("id").alias("hit_id"))


def first_by_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached result of a request: the job that came first with its checksum, by start and id."""
    j = table(spark, sf_dir, "ingestion_jobs").filter("checksum IS NOT NULL").select("checksum", "id", F.unix_micros(parse_time("started_at")).alias("us")).filter("us IS NOT NULL")
    best = j.groupBy("checksum").agg(F.min(F.struct("us", "id")).alias("b"), F.countDistinct("id").alias("jobs"))
    return best.select("checksum", "b.id", F.col("b.us").alias("us"), "jobs")


def upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading book rows one after the other by key: how many are new, the same as what is stored, or in conflict with it (another hash)."""
    b = table(spark, sf_dir, "books").filter("id IS NOT NULL").select("id", "sha256", "loaded_at")
    per = b.groupBy("id", "sha256").agg(F.count("*").alias("n"), F.min("loaded_at").alias("at"))
    first = per.groupBy("id").agg(F.min(F.struct("at", "sha256")).alias("f")).select("id", F.col("f.sha256").alias("stored"))
    kind = F.when(F.col("sha256").eqNullSafe(F.col("stored")), "same").otherwise("conflict")
    e = per.join(first, "id").groupBy("id").agg(F.sum(F.when(kind == "same", F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(kind == "conflict", F.col("n")).otherwise(0)).alias("conflict"))
    return e.agg(F.count("*").alias("inserted"), (F.sum("same") - F.count("*")).alias("unchanged"), F.sum("conflict").alias("conflicts"))


def busy_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of books whose jobs are in given states: both sides are counted per book before they meet."""
    jobs = table(spark, sf_dir, "ingestion_jobs").filter(F.lower("state").isin("failed", "cancelled", "completed")).groupBy(clean_key("book_id").alias("id")).agg(F.countDistinct("id").alias("jobs"))
    chats = table(spark, sf_dir, "chats").groupBy(clean_key("book_id").alias("id")).agg(F.countDistinct("id").alias("chats"))
    books = table(spark, sf_dir, "books").groupBy("id").agg(F.max_by("status", F.struct("loaded_at", "status")).alias("status"))
    return books.join(jobs, "id").join(chats, "id").groupBy("status").agg(F.count("*").alias("books"), F.sum("jobs").alias("jobs"), F.sum("chats").alias("chats"))


def retained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per comparison the runs that win in quality, in speed among those of full quality, or in citations, as a set."""
    cols = ["required_point_coverage", "citation_validity", "p95_latency_seconds"]
    b = table(spark, sf_dir, "leaderboard").groupBy("comparison_id", "run_id").agg(F.max(F.struct("recorded_at", "loaded_at", *cols)).alias("b")).select("comparison_id", "run_id", *[F.col(f"b.{c}").alias(c) for c in cols])
    low = lambda c: F.coalesce(c, F.lit(-1.0))
    keys = [F.struct(low("required_point_coverage"), low("citation_validity"), F.col("run_id")), F.struct(low("citation_validity"), low("required_point_coverage"), F.col("run_id")), F.struct(-F.coalesce("p95_latency_seconds", F.lit(1e300)), F.col("run_id"))]
    won = b.groupBy("comparison_id").agg(*[F.max_by("run_id", k).alias(f"w{i}") for i, k in enumerate(keys)])
    return won.select("comparison_id", F.explode(F.array_distinct(F.array("w0", "w1", "w2"))).alias("run_id"))


def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40-word window of each hit's text with the most distinct query tokens; the earliest of equals."""
    h = _hits(spark, sf_dir).filter("query_text IS NOT NULL AND text IS NOT NULL").withColumn("q", F.array_distinct(X.tokens("query_text"))).filter("size(q) > 0")
    w = h.select("hit_id", "q", F.explode(X.word_windows(F.col("text"), 40, 20)).alias("w"))
    score = F.size(F.array_intersect("q", X.tokens("w.text")))
    best = w.select("hit_id", score.alias("s"), F.col("w.start").alias("start")).groupBy("hit_id").agg(F.max(F.struct("s", -F.col("start"))).alias("b"))
    return best.select("hit_id", F.col("b.s").alias("tokens"), (-F.col("b.col2")).alias("start"))


_FUNCTIONS = (answer_checks, answer_scores, claim_support, near_duplicate_queries, near_duplicate_pieces, gold_units, disjoint_hits, first_by_checksum, upsert_outcomes, busy_books, retained_runs, best_windows)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_KEY = r"nullif(lower(regexp_replace(%s, '^\s+|\s+$', '', 'g')), '')"
_TOK = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[.''-][A-Za-z0-9]+)*'), lambda x: lower(x))"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _content(text: str) -> str:
    """Content tokens: no stop words or single characters, the first ending that leaves four letters cut off."""
    stop = ", ".join(f"'{w}'" for w in "a an and are as at be by for from has have in into is it of on or that the their this to was when where which with".split())
    ends = " ".join(f"WHEN suffix(x, '{e}') AND length(x) - {len(e)} >= 4 THEN left(x, length(x) - {len(e)})" for e in ("ization", "ation", "ingly", "edly", "ing", "ies", "ed", "es", "s"))
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({stop})), lambda x: CASE {ends} ELSE x END))"


SQL = {
    "answer_checks": _HITS + """, e AS (SELECT hit_id, CASE WHEN rank >= 1 THEN NULL ELSE 'invalid status' END AS e1, CASE WHEN len(pdf_pages) >= 1 AND pdf_pages[1] IS NOT NULL AND len(textbook_pages) >= 2 AND textbook_pages[2] IS NOT NULL THEN NULL ELSE 'citation page metadata does not match supplied evidence' END AS e2 FROM h WHERE candidate_id IS NOT NULL AND text IS NOT NULL)
SELECT hit_id, e1 IS NULL AND e2 IS NULL AS valid, concat_ws('; ', e1, e2) AS errors, 1 AS citations, CASE WHEN e2 IS NULL THEN 1 ELSE 0 END AS valid_citations FROM e""",
    "answer_scores": _HITS + f""", t AS (SELECT hit_id, lower(trim(retriever)) AS retriever, {_NORMAL.format("coalesce(query_text, '')")} AS p, {_NORMAL.format("coalesce(section_title, '')")} AS g, CAST(len(list_distinct(coalesce(pdf_pages, []))) + CASE WHEN len(list_filter(coalesce(pdf_pages, []), lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS np FROM h),
w AS (SELECT hit_id, unnest(list_filter(string_split(p, ' '), lambda x: x <> '')) AS w, 1 AS a, 0 AS b FROM t UNION ALL SELECT hit_id, unnest(list_filter(string_split(g, ' '), lambda x: x <> '')), 0, 1 FROM t),
c AS (SELECT hit_id, sum(least(a, b)) AS n FROM (SELECT hit_id, w, sum(a) AS a, sum(b) AS b FROM w GROUP BY ALL) GROUP BY hit_id),
s AS (SELECT retriever, CAST(p = g AS INTEGER) AS em, CASE WHEN p <> g AND (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) THEN 0 ELSE coalesce(n, 0) END AS n, len(list_filter(string_split(p, ' '), lambda x: x <> '')) AS lp, len(list_filter(string_split(g, ' '), lambda x: x <> '')) AS lg, np FROM t LEFT JOIN c USING (hit_id)),
m AS (SELECT retriever, em, CASE WHEN n > 0 THEN n / lp ELSE 0 END AS prec, CASE WHEN n > 0 THEN n / lg ELSE 0 END AS rec, CASE WHEN n > 0 THEN 2 * n / (lp + lg) ELSE 0 END AS f1, CASE WHEN np > 0 THEN 1 / np ELSE 0 END AS sr, CASE WHEN np > 0 THEN 2 / (1 + np) ELSE 0 END AS sf, CASE WHEN np > 0 THEN 1 ELSE 0 END AS sp FROM s)
SELECT retriever, count(*) AS n, round(avg(em), 6) AS em, round(avg(prec), 6) AS prec, round(avg(f1), 6) AS f1, round(avg(sr), 6) AS support_recall, round(avg(sf), 6) AS support_f1, round(avg(CASE WHEN prec * sp + rec * sr > 0 THEN 2 * prec * sp * rec * sr / (prec * sp + rec * sr) ELSE 0 END), 6) AS joint_f1 FROM m GROUP BY retriever""",
    "near_duplicate_queries": r"""WITH q AS (SELECT lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))) AS text, min(query_id) AS id FROM candidates WHERE query_text IS NOT NULL AND query_id IS NOT NULL GROUP BY 1),
s AS (SELECT list_sort(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS s, min(id) AS id FROM q GROUP BY 1), p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.s, b.s)) AS n, len(a.s) AS na, len(b.s) AS nb FROM s a JOIN s b ON a.id < b.id AND len(a.s) * 0.86 <= len(b.s) AND len(b.s) * 0.86 <= len(a.s))
SELECT left_id, right_id, round(n::DOUBLE / (na + nb - n), 4) AS similarity FROM p WHERE n::DOUBLE / (na + nb - n) >= 0.86""",
    "near_duplicate_pieces": """WITH p AS (SELECT piece_id, text FROM text_pieces QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY loaded_at DESC, text DESC NULLS LAST) = 1), s AS (SELECT piece_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS s FROM p WHERE regexp_matches(text, '[A-Za-z0-9]') AND piece_id IS NOT NULL),
c AS (SELECT s, min(piece_id) AS class_id FROM s GROUP BY s), n AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.class_id <> b.class_id WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8 GROUP BY a.class_id)
SELECT piece_id, class_id, coalesce(links, 0) AS links FROM s JOIN c USING (s) LEFT JOIN n USING (class_id)""",
    "claim_support": _HITS + f""", k AS (SELECT lower(trim(retriever)) AS retriever, query_text AS c, text AS t, {_content('query_text')} AS cw, {_content('text')} AS tw FROM h WHERE query_text IS NOT NULL AND text IS NOT NULL)
SELECT retriever, count(*) AS n, count(*) FILTER (WHERE len(list_intersect(cw, tw)) / greatest(1, len(cw)) >= 0.3 AND len(list_filter(regexp_extract_all(c, '\\d+(?:\\.\\d+)?'), lambda x: NOT list_contains(regexp_extract_all(t, '\\d+(?:\\.\\d+)?'), x))) = 0) AS supported FROM k GROUP BY retriever""",
    "gold_units": _HITS + f""", q AS (SELECT query_id, candidate_id, list_distinct({_TOK.format('query_text')}) AS q, list_distinct({_TOK.format("coalesce(text, '')")}) AS t FROM h WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL AND query_text IS NOT NULL),
c AS (SELECT query_id, candidate_id, max(round(len(list_intersect(q, t)) / len(q), 6)) AS coverage FROM q WHERE len(q) > 0 GROUP BY ALL), b AS (SELECT query_id, max(coverage) AS best FROM c GROUP BY query_id)
SELECT query_id, candidate_id, coverage, CAST(row_number() OVER w AS INTEGER) AS place, CASE WHEN row_number() OVER w = 1 THEN 'primary' ELSE 'alternative' END AS role FROM c JOIN b USING (query_id) WHERE best >= 0.5 AND coverage >= 0.5 AND coverage >= round(best * 0.9, 6) WINDOW w AS (PARTITION BY query_id ORDER BY coverage DESC, candidate_id)""",
    "first_by_checksum": "WITH j AS (SELECT checksum, id, epoch_us(CAST(started_at AS TIMESTAMPTZ)) AS us FROM ingestion_jobs WHERE checksum IS NOT NULL AND started_at IS NOT NULL) SELECT checksum, arg_min(id, (us, id)) AS id, min(us) AS us, count(DISTINCT id) AS jobs FROM j GROUP BY checksum",
    "upsert_outcomes": """WITH f AS (SELECT id, sha256 AS stored FROM books WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS FIRST, sha256 NULLS FIRST) = 1)
SELECT count(DISTINCT id) AS inserted, CAST(count(*) FILTER (WHERE sha256 IS NOT DISTINCT FROM stored) - count(DISTINCT id) AS BIGINT) AS unchanged, CAST(count(*) FILTER (WHERE sha256 IS DISTINCT FROM stored) AS BIGINT) AS conflicts FROM books JOIN f USING (id)""",
    "busy_books": f"""WITH j AS (SELECT {_KEY % 'book_id'} AS id, count(DISTINCT id) AS jobs FROM ingestion_jobs WHERE lower(state) IN ('failed', 'cancelled', 'completed') GROUP BY 1), c AS (SELECT {_KEY % 'book_id'} AS id, count(DISTINCT id) AS chats FROM chats GROUP BY 1),
b AS (SELECT id, status FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, status DESC NULLS LAST) = 1) SELECT status, count(*) AS books, CAST(sum(jobs) AS BIGINT) AS jobs, CAST(sum(chats) AS BIGINT) AS chats FROM b JOIN j USING (id) JOIN c USING (id) GROUP BY status""",
    "retained_runs": """WITH r AS (SELECT * FROM leaderboard QUALIFY row_number() OVER (PARTITION BY comparison_id, run_id ORDER BY recorded_at DESC, loaded_at DESC) = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY coalesce(required_point_coverage, -1) DESC, coalesce(citation_validity, -1) DESC, run_id DESC) AS a, row_number() OVER (PARTITION BY comparison_id ORDER BY coalesce(citation_validity, -1) DESC, coalesce(required_point_coverage, -1) DESC, run_id DESC) AS b, row_number() OVER (PARTITION BY comparison_id ORDER BY coalesce(p95_latency_seconds, 1e300), run_id DESC) AS c FROM r)
SELECT comparison_id, run_id FROM w WHERE 1 IN (a, b, c)""",
    "best_windows": _HITS + f""", t AS (SELECT hit_id, list_distinct({_TOK.format('query_text')}) AS q, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM h WHERE query_text IS NOT NULL AND text IS NOT NULL),
s AS (SELECT hit_id, q, w, unnest(list_transform(range(0, CAST(greatest(0, ceil((len(w) - 40) / 20.0)) AS BIGINT) + 1), lambda i: i * 20)) AS start FROM t WHERE len(q) > 0 AND len(w) > 0),
c AS (SELECT hit_id, start, len(list_intersect(q, {_TOK.format("array_to_string(w[start + 1:start + 40], ' ')")})) AS n FROM s)
SELECT hit_id, CAST(n AS INTEGER) AS tokens, CAST(start AS INTEGER) AS start FROM c QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY n DESC, start) = 1""",
}

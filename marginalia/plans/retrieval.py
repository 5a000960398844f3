"""Queries over scoring, fusion, retrieval metrics and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import queries as Q
from marginalia.operators import retrieval as R
from marginalia.operators.ranks import grouped_quantiles
from marginalia.session import table

QUERY_STEP = 100
WEIGHTS = {"page_bm25": 1.0, "page_dense_bge_small": 1.25, "fixed_400_80_bm25": 0.75, "soft_fusion_hybrid": 1.5}
RUN_SCORES = {"required_point_coverage": True, "citation_validity": True, "unsupported_claim_rate": False, "p95_latency_seconds": False}


def bm25_top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for the stated query set: the query texts of every hundredth query id."""
    q = table(spark, sf_dir, "candidates").filter(f"query_id % {QUERY_STEP} = 0 AND query_text IS NOT NULL").groupBy(F.lower(F.trim(F.regexp_replace("query_text", r"\s+", " "))).alias("text")).agg(F.min("query_id").alias("query_id"))
    return R.bm25_top(table(spark, sf_dir, "documents"), q, 10)


def processed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries as they are and with textbook synonyms added, fused by rank; a query no rule changes counts once."""
    q = table(spark, sf_dir, "candidates").filter(f"query_id % {QUERY_STEP} = 0 AND query_text IS NOT NULL").groupBy(F.lower(F.trim(F.regexp_replace("query_text", r"\s+", " "))).alias("text")).agg(F.min("query_id").alias("query_id"))
    docs = table(spark, sf_dir, "documents")
    more = q.withColumn("more", Q.process("textbook_synonym_expansion", F.col("text"))).filter("more <> text").select("query_id", F.col("more").alias("text"))
    both = R.bm25_top(docs, q, 20).withColumn("source", F.lit("original")).unionByName(R.bm25_top(docs, more, 20).withColumn("source", F.lit("processed")))
    f = R.fuse(both, "query_id", "doc_id", "source", "rank").withColumn("fused", F.round("fused", 9))
    return R.top_by(f, "query_id", [F.desc("fused"), F.col("doc_id")], 10)


def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(f"vec_id % {QUERY_STEP} = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_top(e, q, 10).withColumn("score", F.round("score", 6))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "candidates").filter("rank >= 1 AND query_id IS NOT NULL")
    return h.select("hit_id", "query_id", F.lower(F.trim("retriever")).alias("retriever"), "rank", "candidate_id", "book_id", "matches_gold", "pdf_pages", "unit_type", "loaded_at").groupBy("hit_id").agg(F.max_by(F.struct("query_id", "retriever", "rank", "candidate_id", "book_id", "matches_gold", "pdf_pages", "unit_type"), F.struct("loaded_at", "rank", "candidate_id")).alias("h")).select("hit_id", "h.*")


_HITS = "WITH h AS (SELECT DISTINCT hit_id, query_id, lower(trim(retriever)) AS retriever, rank, candidate_id, book_id, matches_gold, pdf_pages, unit_type FROM candidates WHERE rank >= 1 AND query_id IS NOT NULL)\n"


def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fuse(_hits(spark, sf_dir), "query_id", "candidate_id", "retriever", "rank").withColumn("fused", F.round("fused", 9))
    return R.top_by(f, "query_id", [F.desc("fused"), F.col("candidate_id")], 10)


def weighted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fuse(_hits(spark, sf_dir), "query_id", "candidate_id", "retriever", "rank", WEIGHTS).withColumn("fused", F.round("fused", 9))
    return R.top_by(f, "query_id", [F.desc("fused"), F.col("candidate_id")], 10)


def blended_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half plain and half weighted fusion score, each scaled to 0..1 per query."""
    h = _hits(spark, sf_dir)
    a = R.fuse(h, "query_id", "candidate_id", "retriever", "rank").withColumnRenamed("fused", "a")
    b = R.fuse(h, "query_id", "candidate_id", "retriever", "rank", WEIGHTS).withColumnRenamed("fused", "b")
    both = a.join(b, ["query_id", "candidate_id"])
    s = both.select("query_id", "candidate_id", F.round(0.5 * R.minmax("a", "query_id") + 0.5 * R.minmax("b", "query_id"), 9).alias("score"))
    return R.top_by(s, "query_id", [F.desc("score"), F.col("candidate_id")], 5)


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("retriever", "query_id").agg(F.min(F.when(F.col("matches_gold"), F.col("rank"))).alias("first_rank"))


_FIRST = _HITS + ", f AS (SELECT retriever, query_id, min(CASE WHEN matches_gold THEN rank END) AS first_rank FROM h GROUP BY ALL)\n"
_METRICS = "count(*) AS questions, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr"


def retriever_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hit_metrics(_first(spark, sf_dir), ["retriever"])


def scope_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over overlapping scopes: everything, the book series and the unit type."""
    scopes = F.explode(F.array(F.lit("all"), F.concat(F.lit("series:"), F.coalesce(F.regexp_replace("book_id", r"_\d+$", ""), F.lit("none"))), F.concat(F.lit("unit:"), F.coalesce("unit_type", F.lit("none")))))
    f = _hits(spark, sf_dir).select("query_id", scopes.alias("scope"), "rank", "matches_gold").groupBy("scope", "query_id").agg(F.min(F.when(F.col("matches_gold"), F.col("rank"))).alias("first_rank"))
    return R.hit_metrics(f, ["scope"])


def oracle_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries that any retriever solves within a depth."""
    best = _first(spark, sf_dir).groupBy("query_id").agg(F.min("first_rank").alias("r"))
    return best.select(F.explode(F.array(*map(F.lit, (1, 3, 5, 10, 20)))).alias("depth"), "r").groupBy("depth").agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("r") <= F.col("depth"), 1.0).otherwise(0.0)), 6).alias("recall"))


def unique_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = _first(spark, sf_dir).filter("first_rank <= 5").groupBy("query_id").agg(F.count("*").alias("n"), F.min("retriever").alias("retriever"))
    return won.filter("n = 1").groupBy("retriever").agg(F.count("*").alias("wins"))


def retriever_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and joint candidates of every pair of retrievers, per query and in all; retrievers are a handful."""
    sets = _hits(spark, sf_dir).groupBy("query_id", "candidate_id").agg(F.sort_array(F.collect_set("retriever")).alias("rs"))
    names = _hits(spark, sf_dir).groupBy("retriever").agg(F.countDistinct("query_id", "candidate_id").alias("n"))
    pairs = sets.filter(F.size("rs") > 1).select(F.explode(F.filter(F.flatten(F.transform("rs", lambda a: F.transform("rs", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"])).alias("p"))
    shared = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    left, right = names.select(F.col("retriever").alias("a"), F.col("n").alias("na")), names.select(F.col("retriever").alias("b"), F.col("n").alias("nb"))
    return shared.join(left, "a").join(right, "b").select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def page_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks ranked by the best rank of any of their pages among the page hits of the query and book."""
    h = _hits(spark, sf_dir)
    pages = h.filter("unit_type = 'page'").select("query_id", "book_id", F.explode("pdf_pages").alias("page"), "rank").groupBy("query_id", "book_id", "page").agg(F.min("rank").alias("page_rank"))
    chunks = h.filter("unit_type = 'chunk'").select("query_id", "book_id", "candidate_id", F.explode("pdf_pages").alias("page")).distinct()
    lifted = chunks.join(pages, ["query_id", "book_id", "page"]).groupBy("query_id", "candidate_id").agg(F.min("page_rank").alias("best"))
    return R.top_by(lifted, "query_id", [F.col("best"), F.col("candidate_id")], 5)


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _first(spark, sf_dir)
    c = F.when(F.col("first_rank") <= 5, "solved").when(F.col("first_rank").isNotNull(), "relevant_page_ranked_below_top_5").otherwise("lexical_or_semantic_mismatch")
    return f.groupBy("retriever", c.alias("category")).agg(F.count("*").alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [*RUN_SCORES, "p50_latency_seconds", "peak_rss_bytes", "questions", "completed"]
    b = table(spark, sf_dir, "leaderboard").groupBy("comparison_id", "run_id").agg(F.max(F.struct("recorded_at", "loaded_at", *cols)).alias("b"))
    return b.select("comparison_id", "run_id", *[f"b.{c}" for c in cols])


_RUNS = "WITH r AS (SELECT * FROM leaderboard QUALIFY row_number() OVER (PARTITION BY comparison_id, run_id ORDER BY recorded_at DESC, loaded_at DESC) = 1)\n"


def pareto_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pareto_front(_runs(spark, sf_dir), "comparison_id", "run_id", RUN_SCORES)


def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicographic winner: coverage, then citations, then fewest unsupported claims, then latency."""
    key = F.struct(F.coalesce("required_point_coverage", F.lit(-1.0)), F.coalesce("citation_validity", F.lit(-1.0)), -F.coalesce("unsupported_claim_rate", F.lit(9.0)), -F.coalesce("p95_latency_seconds", F.lit(1e300)), F.col("run_id"))
    return _runs(spark, sf_dir).groupBy("comparison_id").agg(F.max_by("run_id", key).alias("run_id"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantiles per comparison, from counts per value."""
    q = grouped_quantiles(_runs(spark, sf_dir), "comparison_id", "p95_latency_seconds", (0.95, 0.5))
    return q.select("comparison_id", "n", F.round("q0", 6).alias("p95"), F.round("q1", 6).alias("p50"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per split and in all, by grouping sets; failures stay in the denominator."""
    r = table(spark, sf_dir, "leaderboard").groupBy("comparison_id", "run_id").agg(F.max(F.struct("recorded_at", "loaded_at", "split", "questions", "completed", "required_point_coverage")).alias("b")).select("b.*")
    g = r.rollup("split").agg(F.count("*").alias("runs"), F.round(F.sum("completed") / F.sum("questions"), 6).alias("completion"), F.round(F.sum(F.coalesce("required_point_coverage", F.lit(0.0))) / F.count("*"), 6).alias("coverage"))
    return g


QUERIES = {f.__name__: f for f in (bm25_top_pages, processed_fusion, dense_neighbours, fused_ranking, weighted_ranking, blended_ranking, retriever_metrics, scope_metrics, oracle_recall, unique_wins, retriever_overlap, page_lift, failure_categories, pareto_runs, best_runs, latency_percentiles, run_summary)}

_TOK = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[.''-][A-Za-z0-9]+)*'), lambda x: lower(x))"
_SYNONYMS = ", ".join("CASE WHEN " + " AND ".join(f"contains(text, '{t}')" for t in triggers) + f" THEN '{terms}' END" for triggers, terms in Q.SYNONYMS)


def _bm25_sql(queries: str, x: str, k: int, first: bool = True) -> str:
    base = f"""q AS (SELECT lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))) AS text, min(query_id) AS query_id FROM candidates WHERE query_id % 100 = 0 AND query_text IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce({_TOK.format('text')}, []) AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
""" if first else ""
    return base + f"""qt{x} AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({_TOK.format('text')}) AS term FROM {queries}) GROUP BY ALL),
tf{x} AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt{x}) GROUP BY ALL),
idf{x} AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf{x}, s GROUP BY term),
sc{x} AS (SELECT query_id, doc_id, round(sum(idf * qn * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf{x} JOIN qt{x} USING (term) JOIN idf{x} USING (term), s GROUP BY ALL),
r{x} AS (SELECT query_id, doc_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM sc{x} WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {k})
"""


_W = "CASE retriever WHEN 'page_bm25' THEN 1.0 WHEN 'page_dense_bge_small' THEN 1.25 WHEN 'fixed_400_80_bm25' THEN 0.75 WHEN 'soft_fusion_hybrid' THEN 1.5 ELSE 1.0 END"
_BEST = _HITS + ", b AS (SELECT query_id, candidate_id, retriever, min(rank) AS rank FROM h GROUP BY ALL)\n"
SQL = {
    "bm25_top_pages": "WITH " + _bm25_sql("q", "", 10) + "SELECT query_id, doc_id, score, rank FROM r",
    "processed_fusion": "WITH " + _bm25_sql("q", "", 20) + f""", qm AS (SELECT query_id, text || ' Related textbook terms: ' || array_to_string(list_filter(list_distinct([{_SYNONYMS}]), lambda x: x IS NOT NULL), ' ') AS text FROM q WHERE len(list_filter([{_SYNONYMS}], lambda x: x IS NOT NULL)) > 0),
""" + _bm25_sql("qm", "m", 20, False) + """, b AS (SELECT * FROM r UNION ALL SELECT * FROM rm), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM b GROUP BY ALL)
SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM f WINDOW w AS (PARTITION BY query_id ORDER BY fused DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
    "dense_neighbours": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "fused_ranking": _BEST + ", f AS (SELECT query_id, candidate_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM b GROUP BY ALL) SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM f WINDOW w AS (PARTITION BY query_id ORDER BY fused DESC, candidate_id) QUALIFY row_number() OVER w <= 10",
    "weighted_ranking": _BEST + f", f AS (SELECT query_id, candidate_id, round(sum({_W}::DOUBLE / (60 + rank)), 9) AS fused FROM b GROUP BY ALL) SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM f WINDOW w AS (PARTITION BY query_id ORDER BY fused DESC, candidate_id) QUALIFY row_number() OVER w <= 10",
    "blended_ranking": _BEST + f""", f AS (SELECT query_id, candidate_id, sum(1.0::DOUBLE / (60 + rank)) AS a, sum({_W}::DOUBLE / (60 + rank)) AS b FROM b GROUP BY ALL),
s AS (SELECT query_id, candidate_id, round(0.5 * CASE WHEN max(a) OVER q > min(a) OVER q THEN (a - min(a) OVER q) / (max(a) OVER q - min(a) OVER q) ELSE 0 END + 0.5 * CASE WHEN max(b) OVER q > min(b) OVER q THEN (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q) ELSE 0 END, 9) AS score FROM f WINDOW q AS (PARTITION BY query_id))
SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, candidate_id) QUALIFY row_number() OVER w <= 5""",
    "retriever_metrics": _FIRST + f"SELECT retriever, {_METRICS} FROM f GROUP BY retriever",
    "scope_metrics": _HITS + f", s AS (SELECT query_id, unnest(['all', 'series:' || coalesce(regexp_replace(book_id, '_\\d+$', ''), 'none'), 'unit:' || coalesce(unit_type, 'none')]) AS scope, rank, matches_gold FROM h), f AS (SELECT scope, query_id, min(CASE WHEN matches_gold THEN rank END) AS first_rank FROM s GROUP BY ALL) SELECT scope, {_METRICS} FROM f GROUP BY scope",
    "oracle_recall": _FIRST + ", b AS (SELECT query_id, min(first_rank) AS r FROM f GROUP BY query_id) SELECT depth, count(*) AS questions, round(avg(CASE WHEN r <= depth THEN 1.0 ELSE 0.0 END), 6) AS recall FROM b, (SELECT unnest([1, 3, 5, 10, 20]) AS depth) GROUP BY depth",
    "unique_wins": _FIRST + "SELECT retriever, count(*) AS wins FROM (SELECT query_id, min(retriever) AS retriever FROM f WHERE first_rank <= 5 GROUP BY query_id HAVING count(*) = 1) GROUP BY retriever",
    "retriever_overlap": _HITS + ", s AS (SELECT DISTINCT query_id, candidate_id, retriever FROM h), n AS (SELECT retriever, count(*) AS n FROM s GROUP BY retriever), p AS (SELECT x.retriever AS a, y.retriever AS b, count(*) AS shared FROM s x JOIN s y USING (query_id, candidate_id) WHERE x.retriever < y.retriever GROUP BY ALL) SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON a = na.retriever JOIN n nb ON b = nb.retriever",
    "page_lift": _HITS + """, p AS (SELECT query_id, book_id, page, min(rank) AS page_rank FROM (SELECT query_id, book_id, unnest(pdf_pages) AS page, rank FROM h WHERE unit_type = 'page') GROUP BY ALL),
c AS (SELECT DISTINCT query_id, book_id, candidate_id, unnest(pdf_pages) AS page FROM h WHERE unit_type = 'chunk'), l AS (SELECT query_id, candidate_id, min(page_rank) AS best FROM c JOIN p USING (query_id, book_id, page) GROUP BY ALL)
SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM l WINDOW w AS (PARTITION BY query_id ORDER BY best, candidate_id) QUALIFY row_number() OVER w <= 5""",
    "failure_categories": _FIRST + "SELECT retriever, CASE WHEN first_rank <= 5 THEN 'solved' WHEN first_rank IS NOT NULL THEN 'relevant_page_ranked_below_top_5' ELSE 'lexical_or_semantic_mismatch' END AS category, count(*) AS n FROM f GROUP BY ALL",
    "pareto_runs": _RUNS + """, v AS (SELECT comparison_id, run_id, coalesce(required_point_coverage, -1e308) AS a, coalesce(citation_validity, -1e308) AS b, coalesce(-unsupported_claim_rate, -1e308) AS c, coalesce(-p95_latency_seconds, -1e308) AS d FROM r)
SELECT comparison_id, run_id FROM v x WHERE NOT EXISTS (SELECT 1 FROM v y WHERE y.comparison_id = x.comparison_id AND y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND y.d >= x.d AND (y.a > x.a OR y.b > x.b OR y.c > x.c OR y.d > x.d))""",
    "best_runs": _RUNS + "SELECT comparison_id, run_id FROM r QUALIFY row_number() OVER (PARTITION BY comparison_id ORDER BY coalesce(required_point_coverage, -1) DESC, coalesce(citation_validity, -1) DESC, coalesce(unsupported_claim_rate, 9), coalesce(p95_latency_seconds, 1e300), run_id DESC) = 1",
    "latency_percentiles": _RUNS + "SELECT comparison_id, count(*) AS n, round(quantile_cont(p95_latency_seconds, 0.95), 6) AS p95, round(quantile_cont(p95_latency_seconds, 0.5), 6) AS p50 FROM r WHERE p95_latency_seconds IS NOT NULL GROUP BY comparison_id",
    "run_summary": _RUNS + "SELECT split, count(*) AS runs, round(sum(completed) / sum(questions), 6) AS completion, round(sum(coalesce(required_point_coverage, 0)) / count(*), 6) AS coverage FROM r GROUP BY ROLLUP (split)",
}

"""Relational statements over books, jobs, chats and events, integrity checks, sampling, and star-schema queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.references import clean_key, parse_time
from marginalia.operators.ranks import as_of_join, range_running_sum
from marginalia.session import table


def _latest(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """The row with the latest loaded_at per key, by a hash aggregate instead of a window."""
    return df.groupBy(key).agg(F.max(F.struct("loaded_at", *cols)).alias("b")).select(key, "b.*")


def _latest_sql(name: str, key: str = "id") -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)"


def live_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that aren't deleted, with the time they were last opened or else created."""
    b = _latest(table(spark, sf_dir, "books"), "id", "book_id", "status", "created_at", "last_opened_at", "deleted_at", "page_count")
    seen = F.coalesce(parse_time("last_opened_at"), parse_time("created_at"))
    return b.filter("deleted_at IS NULL").select("id", "book_id", "status", F.unix_micros(seen).alias("seen_us"))


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state of every book's newest job."""
    j = table(spark, sf_dir, "ingestion_jobs").withColumns({"book": clean_key("book_id"), "at": parse_time("updated_at")}).filter("book IS NOT NULL")
    best = j.groupBy("book").agg(F.max(F.struct("at", "id")).alias("b"))
    return best.select("book", "b.id", F.unix_micros("b.at").alias("at_us"))


def jobs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "ingestion_jobs").filter(F.lower("state").isin("failed", "cancelled", "completed"))
    return j.groupBy(F.lower("state").alias("state"), "error_code").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("jobs"), F.round(F.avg("overall_progress"), 6).alias("progress"))


def book_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats and jobs per live book: both sides are counted before they are joined."""
    b = live_books(spark, sf_dir).select("id", "book_id")
    c = table(spark, sf_dir, "chats").groupBy(clean_key("book_id").alias("id")).agg(F.countDistinct("id").alias("chats"))
    j = table(spark, sf_dir, "ingestion_jobs").groupBy(clean_key("book_id").alias("id")).agg(F.countDistinct("id").alias("jobs"))
    return b.join(c, "id", "left").join(j, "id", "left").select("id", "book_id", F.coalesce("chats", F.lit(0)).alias("chats"), F.coalesce("jobs", F.lit(0)).alias("jobs"))


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of state changes of a job in the order its states arrived."""
    w = Window.partitionBy("id").orderBy("at", "state")
    j = table(spark, sf_dir, "ingestion_jobs").select("id", F.lower("state").alias("state"), parse_time("updated_at").alias("at")).distinct()
    return j.withColumn("before", F.lag("state").over(w)).filter("before IS NOT NULL").groupBy("before", "state").agg(F.count("*").alias("n"))


def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose rows sent again disagree (violations of one value per key)."""
    b = table(spark, sf_dir, "books").groupBy("id").agg(F.countDistinct("sha256").alias("hashes"), F.countDistinct("title").alias("titles"), F.count("*").alias("n"))
    return b.filter("hashes > 1 OR titles > 1")


def book_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats of each book in order, one row each with its place, so that a book with many chats is no single row."""
    c = _latest(table(spark, sf_dir, "chats"), "id", "book_id", "title", "created_at", "deleted_at").filter("deleted_at IS NULL")
    c = c.select(clean_key("book_id").alias("book"), "id", F.unix_micros(parse_time("created_at")).alias("us"), F.coalesce("title", F.lit("")).alias("title"), F.lit(1).cast("long").alias("one"))
    placed = range_running_sum(c.filter("book IS NOT NULL"), ["book"], ["us", "id"], "one", "place")
    return placed.select("book", "place", "id", "title")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties as columns, aggregated per type."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"), F.round(F.avg("value"), 6).alias("value"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events less than 30 minutes apart (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", (F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w), F.lit(1 << 60)) >= 1_800_000_000).cast("int"))
    s = e.withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls within a budget: the first 50 events of every type and day are accepted, however many there are; only their number matters."""
    per = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    accepted = F.least("n", F.lit(50)).cast("long")
    return per.select("event_type", "day", accepted.alias("accepted"), (F.col("n") - accepted).alias("rejected"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents per source in the order of a salted SHA-256 of their id."""
    key = F.sha2(F.concat_ws(":", F.lit("sample"), F.lit(1729), F.col("doc_id")), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(clean_key("source"), F.lit("none")).alias("source"), key.alias("key"))
    w = Window.partitionBy("source").orderBy("key")
    return d.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("source", "doc_id", "place")


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(clean_key("source").alias("source"), F.length("text").alias("n"), "n_chars", "lang")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("chars"), F.count_if(F.col("n") != F.col("n_chars")).alias("wrong_counts"), F.countDistinct(F.lower("lang")).alias("langs"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document text: the smallest doc_id with the same text after collapsing white space and case."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256).alias("digest"))
    classes = d.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return classes.select("class_id", "copies").filter("copies > 1")


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-table join; the planner broadcasts by size."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def order_as_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: for every event of a customer the order that was placed last before it, if any."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    e = table(spark, sf_dir, "events").groupBy("event_id").agg(F.max(F.struct("ts", "user_id")).alias("e")).select("event_id", "e.ts", F.col("e.user_id").alias("key"))
    return as_of_join(e, o, "key", "ts").select("event_id", F.col("right.o_orderkey").alias("o_orderkey"))


_FUNCTIONS = (live_books, latest_jobs, jobs_by_state, book_activity, job_transitions, version_conflicts, book_records, event_properties, event_sessions, budget_ledger, hash_sample, source_profile, exact_copies, price_summary, nation_revenue, customers_without_orders, order_as_of_event)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_KEY = r"nullif(lower(regexp_replace(%s, '^\s+|\s+$', '', 'g')), '')"
_LIVE = f"SELECT id, book_id, status, epoch_us(coalesce(CAST(last_opened_at AS TIMESTAMPTZ), CAST(created_at AS TIMESTAMPTZ))) AS seen_us FROM {_latest_sql('books')} WHERE deleted_at IS NULL"
SQL = {
    "live_books": _LIVE,
    "latest_jobs": f"SELECT book, id, epoch_us(tm) AS at_us FROM (SELECT {_KEY % 'book_id'} AS book, id, CAST(updated_at AS TIMESTAMPTZ) AS tm FROM ingestion_jobs) WHERE book IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book ORDER BY tm DESC, id DESC) = 1",
    "jobs_by_state": "SELECT lower(state) AS state, error_code, count(*) AS rows, count(DISTINCT id) AS jobs, round(avg(overall_progress), 6) AS progress FROM ingestion_jobs WHERE lower(state) IN ('failed', 'cancelled', 'completed') GROUP BY ALL",
    "book_activity": f"WITH b AS ({_LIVE}), c AS (SELECT {_KEY % 'book_id'} AS id, count(DISTINCT id) AS chats FROM chats GROUP BY 1), j AS (SELECT {_KEY % 'book_id'} AS id, count(DISTINCT id) AS jobs FROM ingestion_jobs GROUP BY 1) SELECT b.id, book_id, coalesce(chats, 0) AS chats, coalesce(jobs, 0) AS jobs FROM b LEFT JOIN c ON b.id = c.id LEFT JOIN j ON b.id = j.id",
    "job_transitions": "WITH j AS (SELECT DISTINCT id, lower(state) AS state, CAST(updated_at AS TIMESTAMPTZ) AS tm FROM ingestion_jobs), l AS (SELECT lag(state) OVER (PARTITION BY id ORDER BY tm, state) AS before, state FROM j) SELECT before, state, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL",
    "version_conflicts": "SELECT id, count(DISTINCT sha256) AS hashes, count(DISTINCT title) AS titles, count(*) AS n FROM books GROUP BY id HAVING count(DISTINCT sha256) > 1 OR count(DISTINCT title) > 1",
    "book_records": f"WITH c AS (SELECT {_KEY % 'book_id'} AS book, id, epoch_us(CAST(created_at AS TIMESTAMPTZ)) AS us, coalesce(title, '') AS title FROM (SELECT * FROM chats QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, book_id DESC NULLS LAST, title DESC NULLS LAST) = 1) WHERE deleted_at IS NULL) SELECT book, row_number() OVER (PARTITION BY book ORDER BY us NULLS FIRST, id) - 1 AS place, id, title FROM c WHERE book IS NOT NULL",
    "event_properties": "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max, round(avg(value), 6) AS value FROM events GROUP BY event_type",
    "event_sessions": "WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e) SELECT user_id, session, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY ALL",
    "budget_ledger": "WITH e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) <= 50 THEN 1 ELSE 0 END AS ok FROM events) SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(ok) AS BIGINT) AS accepted, CAST(count(*) - sum(ok) AS BIGINT) AS rejected FROM e GROUP BY ALL",
    "hash_sample": f"SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY key) AS INTEGER) AS place FROM (SELECT doc_id, coalesce({_KEY % 'source'}, 'none') AS source, sha256('sample:1729:' || doc_id) AS key FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY key) <= 5",
    "source_profile": f"SELECT {_KEY % 'source'} AS source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE length(text) <> n_chars) AS wrong_counts, count(DISTINCT lower(lang)) AS langs FROM documents GROUP BY 1",
    "exact_copies": r"SELECT min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) HAVING count(*) > 1",
    "price_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "nation_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
    "order_as_of_event": "WITH o AS (SELECT o_custkey AS key, o_orderdate AS ots, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), e AS (SELECT event_id, ts, user_id AS key FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, user_id DESC) = 1) SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON e.key = o.key AND e.ts >= o.ots",
}

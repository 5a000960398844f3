"""Sources and sinks: JSON lines, Parquet, CSV, gzip, hashed binaries, with checks on what is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType([
    T.StructField("book_id", T.StringType()), T.StructField("pdf_page_number", T.IntegerType()), T.StructField("textbook_page_number", T.StringType()), T.StructField("chapter_number", T.IntegerType()),
    T.StructField("chapter_title", T.StringType()), T.StructField("section_title", T.StringType()), T.StructField("cleaned_text", T.StringType()), T.StructField("has_image", T.BooleanType()),
    T.StructField("has_table", T.BooleanType()), T.StructField("has_equation_like_text", T.BooleanType()), T.StructField("extraction_notes", T.ArrayType(T.StringType())),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; a malformed line or a missing path is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str | Column] | None = None, gzip: bool = False) -> None:
    """JSON lines, globally ordered if asked; the committer replaces the folder as a whole."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("compression", "gzip" if gzip else "none").option("ignoreNullFields", "false").json(path)


def searchable_pages(pages: DataFrame) -> DataFrame:
    """Pages with a printed number and text that aren't front matter or cover."""
    notes = F.coalesce("extraction_notes", F.array().cast("array<string>"))
    return pages.filter(F.col("textbook_page_number").isNotNull() & F.col("cleaned_text").rlike(r"(?U)\S") & ~F.array_contains(notes, "front_matter_or_cover"))


def read_pinned(spark: SparkSession, path: str, key: str, rows: int | None = None) -> DataFrame:
    """Parquet whose key must be unique and not null and whose row count, if given, must match; else ValueError."""
    df = spark.read.parquet(path)
    got = df.agg(F.count("*").alias("n"), F.count(key).alias("k")).first()
    twice = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if got["k"] != got["n"] or twice or rows is not None and got["n"] != rows:
        raise ValueError(f"{path}: {got['n']} rows, {got['k']} keys, repeated keys: {bool(twice)}")
    return df


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of binary files; content is hashed where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_leaderboard(df: DataFrame, path: str) -> None:
    """CSV sorted by coverage, citations (missing last) and latency (missing last), then run."""
    df.orderBy(F.coalesce("required_point_coverage", F.lit(-1.0)).desc(), F.coalesce("citation_validity", F.lit(-1.0)).desc(), F.coalesce("p95_latency_seconds", F.lit(float("inf"))), "run_id").write.mode("overwrite").option("header", "true").csv(path)


def fingerprint(df: DataFrame, *cols: str) -> str:
    """Order-independent SHA-256 of a set of rows: the hash of the sorted row hashes' bitwise sum and count."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    got = df.select(row.alias("h")).agg(F.sum("h").alias("s"), F.bit_xor(F.col("h").cast("bigint")).alias("x"), F.count("*").alias("n"))
    return got.select(F.sha2(F.concat_ws(":", "s", "x", "n"), 256)).first()[0]

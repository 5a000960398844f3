"""Streaming queries, run over all that is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import ensure_checkpoint_dir
from marginalia.streaming.events import read_events, run_available, windowed_counts


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value per day and type from the event stream, late events included for 400 days.

    The result has one row per day and type and is bounded by them.
    """
    ensure_checkpoint_dir(spark)
    name = f"stream_{uuid.uuid4().hex}"
    where = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    counts = run_available(windowed_counts(read_events(spark, f"{sf_dir}/events.parquet*"), late="400 days"), name, where, "complete")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {"stream_daily_counts": stream_daily_counts}
SQL = {"stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL"}

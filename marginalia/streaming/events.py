"""Structured Streaming over event files: deduplicated windows and a per-key life cycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events after which a key is closed (fixed values).
TERMINAL = ("purchase", "error")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; times become TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and value per window and type, each event id counted once within the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def life_cycles(events: DataFrame) -> DataFrame:
    """(user_id, events, last_type, closed) after every batch: counts up to and with the first terminal event of a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, closed = state.get if state.exists else (0, "", False)
        for pdf in batches:
            for kind in pdf.sort_values(["ts", "event_id"]).event_type:
                if not closed:
                    n, last, closed = n + 1, kind, kind in TERMINAL
        state.update((n, last, closed))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_type": [last], "closed": [closed]})

    out = "user_id long, events long, last_type string, closed boolean"
    return events.groupBy("user_id").applyInPandasWithState(step, out, "events long, last_type string, closed boolean", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Run a stream over all that is there now and return its result table (in memory: for tests and small results)."""
    q = stream.writeStream.queryName(name).format("memory").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def publish(stream: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Append every batch to Parquet once: a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

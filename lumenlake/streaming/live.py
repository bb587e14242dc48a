"""Structured Streaming additions: events by window, first of each hash, and new files as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlake.sources.ingest import photo_rows


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of (ts, event_type) counted by tumbling window; closes when the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_each(rows: DataFrame, key: str = "content_hash", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Drops later rows of a key that was seen within the time."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def watch_folder(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs each(photo rows, batch number) for new files; each should upsert, as a batch may come twice."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: each(photo_rows(df), n)).trigger(availableNow=True).start()

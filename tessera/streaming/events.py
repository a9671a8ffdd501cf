"""Event counts in time windows, alike for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, event_type, events, total) of events (ts, event_type, value); of a stream, events later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "total")


def follow(spark: SparkSession, folder: str, files_at_once: int = 10) -> DataFrame:
    """The stream of event files that come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_log(events: DataFrame, folder: str, checkpoint: str):
    """Append a stream's allowed fields to a folder of JSON lines, each event once, until all that is there is written."""
    kept = events.select("event_id", F.col("ts").cast("string").alias("ts"), "event_type")
    return kept.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

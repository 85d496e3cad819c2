"""Streaming twins of the event panel: watermarked windows, sessions and running quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream over Parquet files of events; times are event times in UTC."""
    rows = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts, users (approximate) and values per window and type; closed windows only in append mode."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "users", "value")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed after a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")
    )


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once with the file sink."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

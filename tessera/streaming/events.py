"""Event counts over time windows, the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, events, total); NTZ times are read as UTC, which watermarks need."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "events", F.round("total", 2).alias("total"))


def replay(spark: SparkSession, path: str, schema: object, name: str, checkpoint: str, width: str = "1 hour") -> DataFrame:
    """The windows of a Parquet folder run through the stream to its end, in a memory table."""
    stream = windowed(spark.readStream.schema(schema).parquet(path), width)
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", gap)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")

"""Windows over events; each works on a batch table and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def marked(events: DataFrame, late: str | None) -> DataFrame:
    """A stream's watermark stands on a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "1 hour") if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """event_type, day (the window's begin), n and total of value."""
    grouped = marked(events, late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("event_type", F.col("w.start").alias("day"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, first_ts and n of each run of a user's events that are under gap apart."""
    grouped = marked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("first_ts"), "n")


def stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

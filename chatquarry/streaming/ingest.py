"""Streaming ingest: deduplicated messages and windowed counts from a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import scratch


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages as they come; their times as instants."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(messages: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """One row of each key; the state forgets a key once the watermark has passed it."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def window_counts(messages: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    return messages.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(messages: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's messages with no silence longer than the gap: start, end and number."""
    w = F.session_window("ts", gap)
    return messages.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming table over what there is now, into Parquet in the shared folder, and returns the rows.

    Windows come out once the watermark has passed their end: those of the stream's last stretch are still open."""
    spark = df.sparkSession
    base = scratch(spark)
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")

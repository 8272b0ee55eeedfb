"""Streaming twins of batch operators over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts by day and type; rows later than the watermark are dropped."""
    own = events.withWatermark("ts", late)
    return own.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def first_seen(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

"""Streams of articles and events: file source, watermarked deduplication by url, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def articles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def fresh(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The first article of each lower-cased url within the watermark; blank urls are dropped."""
    s = stream.withColumn("url_key", F.lower(F.trim("url"))).where("url_key <> ''")
    return s.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["url_key"])


def event_counts(stream: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    return stream.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "event_type").agg(F.count("*").alias("n"))

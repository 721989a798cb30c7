"""The decision log as a stream: current state per feature, and windowed counts under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The events under a folder or a pattern (of a single file, a pattern that names it) as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """The last event per feature, by event id."""
    return events.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e"), F.count("*").alias("n")).select("user_id", "e.event_id", "e.event_type", "n")


def counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window; events later than `late` no longer count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

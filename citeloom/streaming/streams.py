"""Structured Streaming forms: event-time windows, deduplicated deliveries and a resumable copy of a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, like: DataFrame, glob: str = "*.parquet", per_trigger: int = 16) -> DataFrame:
    """A stream over a folder of parquet files with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, by: str, value: str, size: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sum of value in event-time windows; rows later than `late` are dropped by the watermark."""
    e = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    w = F.window("__at", size, slide) if slide else F.window("__at", size)
    return e.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def first_deliveries(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Repeated deliveries dropped, with state kept only within the watermark."""
    return rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")


def copy_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and ends; a later run with the same checkpoint goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Findings as a stream: deliveries in any order, counted by scan time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_deliveries(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Parquet deliveries of a folder as a stream, so many files at a time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))  # watermarks need a time zone


def deduplicated(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """The first delivery of every finding; a repetition within the watermark is dropped, state older than it too."""
    return stream.withWatermark("scanned_at", late).dropDuplicatesWithinWatermark(["finding_id"])


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Findings by window of scan time and tool."""
    w = stream.withWatermark("scanned_at", late).groupBy(F.window("scanned_at", width).alias("w"), "tool").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "tool", "n")

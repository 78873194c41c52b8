"""Streaming forms: totals of placements by time window and family, and a stream of files' kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import source_kind


def windowed_totals(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and DECIMAL sum of ``value`` by window and keys; rows later than ``late`` are dropped by the watermark.

    State is one row for each open window and key, whatever the number of rows.
    """
    held = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    sums = held.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).alias("total"))
    return sums.select(F.col("w.start").alias("begin"), *keys, "n", "total")


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files that arrive in a folder: path, length, kind."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return files.select("path", "length", source_kind(F.col("path")).alias("kind"))

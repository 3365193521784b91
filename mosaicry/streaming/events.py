"""Streams of events and of new files. An addition of this library: batch results do not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def window_counts(events: DataFrame, at: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n, total) per window and kind, for streams and tables; later events than ``late`` may be left out of a stream."""
    w = events.withWatermark(at, late).groupBy(F.window(at, size), kind)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user, start, end, n): runs of one user's events with no gap of ``gap`` or more."""
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap), user)
    return w.agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later run goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

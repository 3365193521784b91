"""Queries on the events table with the operators for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.streaming.events import sessions, window_counts
from mosaicry.tables import load


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return window_counts(e, "ts", "event_type", "value").select(F.unix_seconds("start").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions with gaps under half an hour."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "user_id").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions}

ORACLE = {
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL), b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800000000, true)::INT AS s FROM e),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n FROM k GROUP BY user_id, k.k""",
}

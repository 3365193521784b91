"""Loading of named tables, and the sizes that decide on broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.scratch import honest_sizes

#: Bytes up to which a side whose size was measured may be broadcast.
BROADCAST_LIMIT = 64 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    honest_sizes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key, for tables whose repeated rows are equal in all columns."""
    return df.dropDuplicates(list(keys))


def small(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit the limit, else as it is.

    ``df`` should be cheap to count: a written table or a scan.
    """
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df

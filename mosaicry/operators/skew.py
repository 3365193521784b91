"""Equi-joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.scratch import materialize
from mosaicry.tables import BROADCAST_LIMIT

#: Rows of one key that one task takes.
BLOCK = 20_000


def hot_keys(df: DataFrame, key: str, block: int = BLOCK) -> DataFrame | None:
    """Keys with more than ``block`` rows and the number of parts they need; None if there are none.

    The result has at most rows/block rows.
    """
    t = materialize(
        df.groupBy(key).count().filter(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("_parts")),
        "hot",
    )
    return None if t.isEmpty() else t


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, block: int = BLOCK) -> DataFrame:
    """Inner equi-join on ``key``; a key that is hot in ``left`` is cut into parts.

    Every left row gets one part, chosen by the hash of ``spread``; right rows of
    a hot key are copied to each part. So each pair meets exactly once and no task
    takes more than about ``block`` left rows of one key. Null keys join nothing.
    """
    hot = hot_keys(left.filter(F.col(key).isNotNull()), key, block)
    if hot is None:
        return left.join(right, key)
    if hot.count() * 32 <= BROADCAST_LIMIT:
        hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def left_join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on ``key`` in which rows without a key do not all go to one task.

    They meet nobody, so they are spread by the hash of ``spread``.
    """
    a = left.withColumn("_spread", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(4096))).otherwise(F.lit(-1)).cast("int"))
    return a.join(right.withColumn("_spread", F.lit(-1)), [key, "_spread"], "left").drop("_spread")

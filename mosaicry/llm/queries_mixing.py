"""Queries on mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaicry.llm.mixing import mix, with_tokens
from mosaicry.tables import load


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = with_tokens(load(spark, d, "documents").select("doc_id", "source", "text"), "text")
    return mix(docs, load(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents to take and how often."""
    return _mix(spark, d)[0].withColumnRenamed("size", "n_tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What share each source reached."""
    return _mix(spark, d)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}

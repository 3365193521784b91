"""Queries on names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.llm.names import link_names
from mosaicry.operators.skew import salted_join
from mosaicry.tables import load


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return link_names(load(spark, d, "people"), "id", "preferred_name", load(spark, d, "meta_face_regions"), "id", "name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    people, faces = _linked(spark, d)
    a, b = (people.select("person_id", F.col("id").alias(k)) for k in ("key_a", "key_b"))
    pairs = salted_join(a, b, "person_id", "key_a").filter("key_a < key_b").select(F.lit("people").alias("kind"), "key_a", "key_b")
    return pairs.unionByName(faces.select(F.lit("face").alias("kind"), F.col("id").alias("key_a"), F.col("person_id").alias("key_b")))


def p5_persons(spark: SparkSession, d: str) -> DataFrame:
    """Each registered person with the number of register rows and face regions that mean them."""
    people, faces = _linked(spark, d)
    n = faces.groupBy("person_id").agg(F.count("*").alias("n_faces"))
    rows = people.groupBy("person_id").agg(F.count("*").alias("n_rows"))
    return rows.join(n, "person_id", "left").select("person_id", "n_rows", F.coalesce("n_faces", F.lit(0)).alias("n_faces"))


QUERIES = {"p5_found": p5_found, "p5_persons": p5_persons}
ORACLE: dict[str, str] = {}

"""Registers kept as CSV files, and polygons kept as GeoJSON or KML."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLYGON = "array<array<array<struct<lon:double,lat:double>>>>"


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip().lstrip("﻿")).strip("_").lower()


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with its headers in snake case, all strings; rows whose first column is empty or '-' are left out."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[snake(c) for c in df.columns])
    key = F.trim(F.col(df.columns[0]))
    return df.filter(key.isNotNull() & ~key.isin("", "-"))


def name_forms(people: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, form, name) of name columns whose values may hold several names parted by a bar."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("form"), F.split(F.col(c), r"\|").alias("names")) for c in columns]))
    p = people.select(key, parts.alias("p")).select(key, "p.form", F.explode("p.names").alias("name"))
    return p.select(key, "form", F.trim("name").alias("name")).filter("name <> '' AND name <> '-'").distinct()


def life_events(people: DataFrame, key: str, events: dict[str, str], spouse: str | None = None) -> DataFrame:
    """(key, event, date, spouse_key): the date columns turned to rows; a spouse only if registered too."""
    e = people.select(key, *([F.col(spouse).alias("_s")] if spouse else []), F.explode(F.array(*[F.struct(F.lit(v).alias("event"), F.col(k).alias("date")) for k, v in events.items()])).alias("e"))
    e = e.select(key, *(["_s"] if spouse else []), "e.event", F.trim("e.date").alias("date")).filter("date <> '' AND date <> '-'")
    if not spouse:
        return e.withColumn("spouse_key", F.lit(None).cast("string"))
    known = people.select(F.col(key).alias("spouse_key")).distinct()
    return e.join(known, F.col("_s") == F.col("spouse_key"), "left").drop("_s")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(name, polygon) of the Polygon and MultiPolygon features of GeoJSON files; a name is properties.name, NAME, or the file's."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("stem"))
    whole = F.get_json_object("value", "$.features")
    many = F.from_json(F.coalesce(whole, F.concat(F.lit("["), F.col("value"), F.lit("]"))), "array<string>")
    f = text.select("stem", F.explode(many).alias("f"))
    at = lambda p: F.get_json_object("f", p)
    kind = at("$.geometry.type")
    parts = F.when(kind == "Polygon", F.array(F.from_json(at("$.geometry.coordinates"), "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(at("$.geometry.coordinates"), "array<array<array<array<double>>>>"))
    polygon = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))
    full = lambda c: F.when(F.trim(c) != "", c)
    return f.select(F.coalesce(full(at("$.properties.name")), full(at("$.properties.NAME")), "stem").alias("name"), polygon.alias("polygon")).filter("polygon IS NOT NULL")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, polygon) of KML files: each ring of at least three points is a polygon of its own, named by its placemark or file."""
    return kml_polygons(spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("stem")))


def kml_polygons(text: DataFrame) -> DataFrame:
    """(name, polygon) of KML documents given as (stem, value)."""
    marks = F.regexp_extract_all("value", F.lit(r"(?s)(<Placemark[ >].*?</Placemark>)"), 1)
    m = text.select("stem", F.explode(marks).alias("m"))
    name = F.trim(F.regexp_extract("m", r"(?s)<name>(.*?)</name>", 1))
    rings = F.regexp_extract_all("m", F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), 1)
    m = m.select(F.when(name != "", name).otherwise(F.col("stem")).alias("name"), F.explode(rings).alias("r"))
    pts = F.transform(F.filter(F.split(F.trim("r"), r"\s+"), lambda t: t != ""), lambda t: F.split(t, ","))
    ring = F.filter(F.transform(pts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lon"), F.get(p, F.lit(1)).try_cast("double").alias("lat"))), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return m.select("name", ring.alias("ring")).filter(F.size("ring") >= 3).select("name", F.array(F.array("ring")).alias("polygon"))


def circle(lat: float, lon: float, radius_m: float, corners: int = 64) -> list:
    """A polygon around a point, its radius taken as radius_m / 111320 degrees in both directions."""
    from math import cos, pi, sin

    r = radius_m / 111_320
    return [[[{"lon": lon + r * cos(2 * pi * i / corners), "lat": lat + r * sin(2 * pi * i / corners)} for i in range(corners)]]]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; arrays and structs become JSON. Written in parallel, one file per task."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)

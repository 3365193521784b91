"""Polygons kept in KMZ archives and shapefiles, read whole by one task per file."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.sources.registers import POLYGON, kml_polygons


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """(name, polygon) of the first KML document in each KMZ file; archives without one or that cannot be read give none."""

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for stem, content in zip(b["stem"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = sorted(n for n in z.namelist() if n.lower().endswith(".kml"))
                        if inner:
                            rows.append((stem, z.read(inner[0]).decode("utf-8", "replace")))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["stem", "value"])

    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "content")
    return kml_polygons(f.mapInPandas(text, "stem string, value string"))


def shapes(content: bytes) -> list[tuple[int, list]]:
    """(record number, polygon) of the polygon records (types 5, 15 and 25) of a shapefile; each ring is listed in one part."""
    out, at = [], 100
    while at + 8 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        xy = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        rings = [[{"lon": xy[2 * i], "lat": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        out.append((number, [rings]))
    return out


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(name, record, polygon) of shapefiles; attributes lie in other files and are joined by record number."""

    @F.udf(f"array<struct<record:int,polygon:{POLYGON}>>")
    def parse(content: bytes):
        return shapes(bytes(content))

    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), F.explode(parse("content")).alias("s"))
    return f.select("name", "s.record", "s.polygon")

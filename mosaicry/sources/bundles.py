"""Registers and regions kept in folders: bundles of tables, regions of several formats, privacy zones, and the list of sources itself."""

from __future__ import annotations

import csv
import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.operators.matching import similar_names
from mosaicry.sources.archives import read_kmz, read_shapes
from mosaicry.sources.registers import POLYGON, circle, read_geojson, read_kml, read_register, snake


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one for each key; a null is a key like any other."""
    cond = F.lit(True)
    have = old.select(*[F.col(k).alias("_" + k) for k in keys]).distinct()
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_" + k))
    fresh = new.dropDuplicates(keys).join(have, cond, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def read_regions(spark: SparkSession, folder: str, level: str = "custom") -> DataFrame:
    """(name, level, polygon) of all GeoJSON, KML, KMZ and shape files of a folder; other files are left alone."""
    readers = {"geojson": read_geojson, "json": read_geojson, "kml": read_kml, "kmz": read_kmz, "shp": read_shapes}
    out = None
    for ext, read in sorted(readers.items()):
        if glob.glob(os.path.join(folder, f"*.{ext}")):
            r = read(spark, os.path.join(folder, f"*.{ext}")).select("name", F.lit(level).alias("level"), F.col("polygon").cast(POLYGON).alias("polygon"))
            out = r if out is None else out.unionByName(r)
    return out if out is not None else spark.createDataFrame([], f"name string, level string, polygon {POLYGON}")


def named_regions(shapes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(country, country_code, state, polygon) of shapes with their attribute rows (record, and the usual columns of country and state maps).

    The first known of several columns counts: NAME_LONG, ADMIN and admin for the country, ISO_A2,
    ADM0_A3 and adm0_a3 for its code (blank and -99 are unknown), name for the state.
    """
    have = set(attributes.columns)
    known = lambda c: F.when((F.trim(c) != "") & (F.trim(c) != "-99"), F.trim(c))
    pick = lambda *cs: F.coalesce(*[known(c) for c in cs if c in have], F.lit(None).cast("string"))
    j = shapes.join(attributes, "record")
    return j.select(pick("NAME_LONG", "ADMIN", "admin").alias("country"), pick("ISO_A2", "ADM0_A3", "adm0_a3").alias("country_code"), pick("name").alias("state") if "admin" in have else F.lit(None).cast("string").alias("state"), "polygon")


def read_zones(spark: SparkSession, entries: list[dict], folder: str = ".") -> DataFrame:
    """(name, mode, decimal_places, polygon) of privacy zones given as a list of settings.

    An entry has a name, a mode (strip or coarsen, strip by default), decimal_places (2 by
    default) and either a file of ``folder``, of which the first polygon counts, or a center (lat, lon) and radius_m. Others are left out.
    """
    rows = []
    for e in entries:
        polygon = None
        if e.get("file"):
            path = os.path.join(folder, e["file"])
            read = {".kml": read_kml, ".kmz": read_kmz, ".shp": read_shapes}.get(os.path.splitext(path)[1].lower(), read_geojson)
            first = read(spark, path).limit(1).collect() if os.path.exists(path) else []
            polygon = [[[(p["lon"], p["lat"]) for p in ring] for ring in part] for part in first[0]["polygon"]] if first else None
        elif e.get("center") and e.get("radius_m"):
            polygon = [[[(p["lon"], p["lat"]) for p in ring] for ring in part] for part in circle(e["center"][0], e["center"][1], e["radius_m"])]
        if polygon:
            rows.append((e.get("name"), e.get("mode", "strip"), int(e.get("decimal_places", 2)), polygon))
    return spark.createDataFrame(rows, f"name string, mode string, decimal_places int, polygon {POLYGON}")


def read_zone_file(spark: SparkSession, path: str) -> DataFrame:
    """Privacy zones of a YAML file with a list ``zones``; files they name lie beside it. Needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return read_zones(spark, (yaml.safe_load(f) or {}).get("zones") or [], os.path.dirname(path))


def _read_list(spark: SparkSession, path: str) -> DataFrame:
    """A short CSV list of settings, all strings. Spark takes files whose names begin with an underscore for hidden ones, so the driver reads it."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        head, *rows = list(csv.reader(f)) or [["name"]]
    names = [snake(h) for h in head]
    rows = [(r + [None] * len(names))[: len(names)] for r in rows if r and r[0].strip() not in ("", "-")]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle: _registry, each table that it names and that is there, and _links if there are any."""
    registry = _read_list(spark, os.path.join(folder, "_registry.csv"))
    out = {"_registry": registry}
    for name in sorted({r["table_name"] for r in registry.collect()}):  # a handful of names
        path = os.path.join(folder, f"{name}.csv")
        if os.path.exists(path):
            out[name] = read_register(spark, path)
    links = os.path.join(folder, "_links.csv")
    return out | ({"_links": _read_list(spark, links)} if os.path.exists(links) else {})


def new_locations(register: DataFrame, rows: DataFrame, name: str, threshold: float = 0.85, force: bool = False) -> DataFrame:
    """``rows`` to be added to a register of places; names too like a known or another new one raise an error unless ``force``.

    A name that the register has already is an update and no duplicate.
    """
    if not force:
        both = register.select(F.col(name).alias("name"), F.lit(True).alias("old")).unionByName(rows.select(F.col(name).alias("name"), F.lit(False).alias("old")))
        fresh = both.groupBy("name").agg(F.max("old").alias("old")).filter("NOT old").select("name")
        pairs = similar_names(both.select("name"), "name", threshold)
        side = lambda c: pairs.join(fresh.withColumnRenamed("name", c), c, "left_semi").select(pairs.columns)
        hit = side("name_a").unionByName(side("name_b"))
        first = hit.distinct().orderBy(F.desc("ratio"), "name_a", "name_b").limit(5).collect()
        if first:
            raise ValueError("; ".join(f"{r['name_a']} ~ {r['name_b']} ({r['ratio']})" for r in first))
    return rows


def clusters_as_places(clusters: DataFrame, eps_km: float) -> DataFrame:
    """(location, latitude, longitude, threshold_m) of clusters (label, lat, lon), all as text, as a register of places holds them."""
    return clusters.select(F.col("label").alias("location"), F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), F.lit(str(eps_km * 1000)).alias("threshold_m"))


def added_source(sources: DataFrame, path: str, **values) -> DataFrame:
    """``sources`` (id, path, ...) with one more, under the next id, unless its path is known."""
    if sources.filter(F.col("path") == path).limit(1).count():
        return sources
    top = sources.agg(F.max("id")).first()[0] or 0
    one = sources.sparkSession.createDataFrame([(top + 1, path)], "id long, path string").select("id", "path", *[F.lit(v).alias(k) for k, v in values.items() if k in sources.columns])
    return sources.unionByName(one, allowMissingColumns=True)


def changed_source(sources: DataFrame, source_id: int, **values) -> DataFrame:
    """``sources`` with other values for a source that is not removed; an unknown or removed one stays as it is."""
    hit = (F.col("id") == source_id) & F.col("removed_at").isNull()
    return sources.withColumns({k: F.when(hit, F.lit(v).cast(sources.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def without_source(sources: DataFrame, files: DataFrame, tables: dict[str, DataFrame], source_id: int, at: Column | None = None, cascade: bool = False) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(sources, files, tables) after a source was removed: marked with the time, and with ``cascade`` without its files and all rows that belong to them."""
    hit = (F.col("id") == source_id) & F.col("removed_at").isNull()
    sources = sources.withColumn("removed_at", F.when(hit, F.current_timestamp() if at is None else at).otherwise(F.col("removed_at")))
    if not cascade:
        return sources, files, tables
    gone = files.filter(F.col("source_id") == source_id).select(F.col("id").alias("file_id")).distinct()
    kept = files.filter(F.col("source_id").isNull() | (F.col("source_id") != source_id))
    return sources, kept, {k: t.join(gone, "file_id", "left_anti") for k, t in tables.items()}


def stamped_source(sources: DataFrame, source_id: int, n_files: int, at: Column | None = None) -> DataFrame:
    """``sources`` with the time and the number of files of a source's last run."""
    hit = F.col("id") == source_id
    now = F.current_timestamp() if at is None else at
    return sources.withColumns({"last_ingested_at": F.when(hit, now).otherwise(F.col("last_ingested_at")), "file_count_ingested": F.when(hit, F.lit(n_files).cast("long")).otherwise(F.col("file_count_ingested"))})


# Names of columns that hold other names of a row.
ALIAS_COLUMNS = frozenset("aliases alias alt_name alt_names nickname nicknames aka also_known_as".split())


def alias_columns(names: list[str]) -> list[str]:
    """Those of ``names`` that hold other names, whatever their case."""
    return [n for n in names if n.lower() in ALIAS_COLUMNS]


def alias_groups(table: DataFrame, key: str) -> DataFrame:
    """(canonical, terms): each key with its other names, parted by bars in the alias columns; keys without any are left out."""
    cols = alias_columns([c for c in table.columns if c != key])
    if not cols:
        return table.select(F.col(key).alias("canonical"), F.array(F.col(key)).alias("terms")).limit(0)
    parts = F.concat(*[F.split(F.coalesce(F.col(c), F.lit("")), r"\|") for c in cols])
    other = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & (x != F.col(key)))
    return table.filter(F.col(key) != "").select(F.col(key).alias("canonical"), F.concat(F.array(F.col(key)), other).alias("terms")).filter(F.size("terms") > 1)

"""Queries on points near points and in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.operators.spatial import containing_polygons, near_pairs
from mosaicry.tables import load, once

NEAR_M = 150.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pts = load(spark, d, "gps_proposals").select("id", "proposed_lat", "proposed_lon")
    pairs = near_pairs(pts, "id", "proposed_lat", "proposed_lon", NEAR_M)
    out = pairs.select(F.lit("near").alias("kind"), F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))
    for kind, table, key in (("region", "region_records", "region_id"), ("zone", "privacy_zones", "zone_id")):
        poly = once(load(spark, d, table).select(key, "polygon"), key)
        hit = containing_polygons(pts, "id", "proposed_lat", "proposed_lon", poly, key)
        out = out.unionByName(hit.select(F.lit(kind).alias("kind"), F.col("id").alias("key_a"), F.col("poly_id").alias("key_b")))
    return out


QUERIES = {"p1_found": p1_found}

_POLY = """
{t}_edges AS (
  SELECT pid, ring[i].lon AS x1, ring[i].lat AS y1, ring[i % len(ring) + 1].lon AS x2, ring[i % len(ring) + 1].lat AS y2
  FROM (SELECT pid, ring, unnest(range(1, len(ring) + 1)) AS i
        FROM (SELECT pid, unnest(part) AS ring
              FROM (SELECT {key} AS pid, unnest(polygon) AS part FROM (SELECT DISTINCT ON ({key}) {key}, polygon FROM {t})))
        WHERE len(ring) > 2)),
{t}_hits AS (
  SELECT p.id, e.pid FROM pts p JOIN {t}_edges e
    ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY p.id, e.pid HAVING count(*) % 2 = 1)"""

ORACLE = {
    "p1_found": f"""
WITH pts AS (
  SELECT DISTINCT id, proposed_lat AS lat, proposed_lon AS lon FROM gps_proposals
  WHERE abs(proposed_lat) <= 90 AND abs(proposed_lon) <= 180 AND NOT (proposed_lat = 0 AND proposed_lon = 0)),
{_POLY.format(t="region_records", key="region_id")},
{_POLY.format(t="privacy_zones", key="zone_id")}
SELECT 'near' AS kind, a.id AS key_a, b.id AS key_b FROM pts a JOIN pts b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.0014
WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 150
UNION ALL SELECT 'region', id, pid FROM region_records_hits
UNION ALL SELECT 'zone', id, pid FROM privacy_zones_hits
""",
}

"""Queries on places, regions, privacy zones and clusters of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.functions.geo import masked, usable_point
from mosaicry.operators.facts import prefer
from mosaicry.operators.graph import dbscan
from mosaicry.operators.matching import mentions, nearest_place, places_within, similar_names
from mosaicry.operators.spatial import containing_polygons
from mosaicry.tables import load, once, small

LEVELS = {"custom": 0, "state": 1, "country": 2}


def _points(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "gps_proposals"), "id").select("id", F.col("proposed_lat").alias("lat"), F.col("proposed_lon").alias("lon"), "threshold_m", "location_name", "status")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """The accepted proposals, each a place of its own radius under the number of its proposal."""
    return _points(spark, d).filter("lower(trim(status)) = 'accepted'").select(F.col("id").alias("place"), "lat", "lon", F.col("threshold_m").alias("radius_m"))


def place_matches(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).filter("status IS NULL OR lower(trim(status)) <> 'accepted'")
    return places_within(p, _places(spark, d)).select("id", "place")


def nearest_places(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).filter("status IS NULL OR lower(trim(status)) <> 'accepted'")
    return nearest_place(p, _places(spark, d)).select("id", "place", F.round("distance_m", 3).alias("distance_m"))


def region_labels(spark: SparkSession, d: str) -> DataFrame:
    """One region per point: custom before state before country, then the smaller number, with its names."""
    r = once(load(spark, d, "region_records"), "region_id")
    hit = containing_polygons(_points(spark, d), "id", "lat", "lon", r, "region_id")
    known = lambda c: F.when((F.col(c) != "") & (F.col(c) != "-99"), F.col(c)).alias(c)
    r = r.select(F.col("region_id").alias("poly_id"), "level", *[known(c) for c in ("country", "country_code", "state", "custom_name")])
    rank = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])
    best = prefer(hit.join(small(r, 400), "poly_id"), ["id"], [F.coalesce(F.try_element_at(rank, F.col("level")), F.lit(9)), F.col("poly_id")])
    return best.select("id", F.col("poly_id").alias("region_id"), "country", "country_code", "state", "custom_name")


def zone_masks(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of points in a privacy zone as they may be shown: strip beats coarsen, then the fewest places."""
    z = once(load(spark, d, "privacy_zones"), "zone_id")
    pts = _points(spark, d)
    hit = containing_polygons(pts, "id", "lat", "lon", z, "zone_id").join(small(z.select(F.col("zone_id").alias("poly_id"), "mode", "decimal_places"), 100), "poly_id")
    best = prefer(hit, ["id"], [F.col("mode") == "coarsen", F.coalesce("decimal_places", F.lit(2)), F.col("poly_id")])
    j = best.join(pts.select("id", "lat", "lon"), "id")
    m = lambda c: masked(F.col(c), F.col("mode"), F.coalesce("decimal_places", F.lit(2)))
    return j.select("id", F.col("poly_id").alias("zone_id"), "mode", m("lat").alias("lat"), m("lon").alias("lon"))


def point_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of points within 300 m, five points at least."""
    return dbscan(_points(spark, d), "id", "lat", "lon", 300.0, 5)


def cluster_centres(spark: SparkSession, d: str) -> DataFrame:
    """Each density cluster's centre, size and commonest place name (ties: the first by alphabet)."""
    c = point_clusters(spark, d).filter("cluster_id IS NOT NULL").join(_points(spark, d), "id")
    # whole millionths of a degree, so that sums do not depend on the order of rows
    mean = lambda x: F.floor(F.sum(F.round(F.col(x) * 1_000_000).cast("long")) / F.count("*")).alias(x + "_micro")
    size = c.groupBy("cluster_id").agg(F.count("*").alias("n"), mean("lat"), mean("lon"))
    names = c.withColumn("name", F.lower(F.trim("location_name"))).filter("name <> ''").groupBy("cluster_id", "name").agg(F.count("*").alias("k"))
    name = names.groupBy("cluster_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "name")).alias("b"))
    return size.join(name, "cluster_id", "left").select("cluster_id", "n", "lat_micro", "lon_micro", F.coalesce("b.name", F.concat(F.lit("cluster "), F.col("cluster_id"))).alias("name"))


def place_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names of proposals that stand in documents: how many documents each."""
    names = _points(spark, d).select(F.lower(F.trim("location_name")).alias("name")).filter("length(name) > 3")
    m = mentions(load(spark, d, "documents"), "doc_id", "text", names, "name")
    return m.groupBy("term").agg(F.count("*").alias("n_docs")).withColumnRenamed("term", "name")


def similar_places(spark: SparkSession, d: str) -> DataFrame:
    """Names of proposals that are spelled alike."""
    return similar_names(_points(spark, d).select(F.lower(F.trim("location_name")).alias("name")).distinct(), "name", 0.85)


def usable_points(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return p.groupBy(usable_point(F.col("lat"), F.col("lon")).alias("usable")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (place_matches, nearest_places, region_labels, zone_masks, point_clusters, cluster_centres, place_mentions, similar_places, usable_points)}

_P = "(SELECT DISTINCT ON (id) id, proposed_lat AS lat, proposed_lon AS lon, threshold_m, location_name, status FROM gps_proposals)"
_OK = "abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)"
_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_NEAR = f"""WITH p AS (SELECT * FROM {_P} WHERE {_OK}), q AS (SELECT id AS place, lat, lon, CASE WHEN threshold_m > 0 THEN threshold_m ELSE 500 END AS r FROM p WHERE lower(trim(status)) = 'accepted'),
m AS (SELECT a.id, b.place, {_DIST} AS dist, r FROM p a, q b WHERE a.status IS NULL OR lower(trim(a.status)) <> 'accepted')"""
_IN = """WITH p AS (SELECT * FROM {p} WHERE {ok}), t AS (SELECT DISTINCT ON ({key}) * FROM {t}),
e AS (SELECT pid, ring[i].lon AS x1, ring[i].lat AS y1, ring[i % len(ring) + 1].lon AS x2, ring[i % len(ring) + 1].lat AS y2
  FROM (SELECT pid, ring, unnest(range(1, len(ring) + 1)) AS i FROM (SELECT pid, unnest(part) AS ring FROM (SELECT {key} AS pid, unnest(polygon) AS part FROM t)) WHERE len(ring) > 2)),
h AS (SELECT p.id, e.pid FROM p JOIN e ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY p.id, e.pid HAVING count(*) % 2 = 1)"""
_DB = f"""WITH RECURSIVE p AS (SELECT * FROM {_P} WHERE {_OK}),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.lat - b.lat) <= 0.003 AND {_DIST} <= 300),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5),
e AS (SELECT a, b FROM n WHERE a IN (FROM core) AND b IN (FROM core)),
r AS (SELECT a AS node, a AS other FROM core UNION SELECT node, e.b FROM r JOIN e ON e.a = other),
c AS (SELECT node, min(other) AS c FROM r GROUP BY node),
x AS (SELECT p.id, coalesce(c.c, (SELECT min(c2.c) FROM n JOIN c c2 ON c2.node = n.b WHERE n.a = p.id)) AS cluster_id FROM p LEFT JOIN c ON c.node = p.id)"""

ORACLE = {
    "place_matches": _NEAR + " SELECT id, place FROM m WHERE dist <= r",
    "nearest_places": _NEAR + " SELECT id, arg_min(place, (dist, place)) AS place, round(min(dist), 3) AS distance_m FROM m WHERE dist <= r GROUP BY id",
    "region_labels": _IN.format(p=_P, ok=_OK, t="region_records", key="region_id") + """, k AS (SELECT h.id, arg_min(pid, (CASE level WHEN 'custom' THEN 0 WHEN 'state' THEN 1 WHEN 'country' THEN 2 ELSE 9 END, pid)) AS region_id FROM h JOIN t ON t.region_id = pid GROUP BY h.id)
SELECT k.id, k.region_id, nullif(nullif(country, ''), '-99') AS country, nullif(nullif(country_code, ''), '-99') AS country_code, nullif(nullif(state, ''), '-99') AS state, nullif(nullif(custom_name, ''), '-99') AS custom_name FROM k JOIN t USING (region_id)""",
    "zone_masks": _IN.format(p=_P, ok=_OK, t="privacy_zones", key="zone_id") + """, k AS (SELECT h.id, arg_min(pid, (CASE WHEN mode = 'coarsen' THEN 1 ELSE 0 END, coalesce(decimal_places, 2), pid)) AS zone_id FROM h JOIN t ON t.zone_id = pid GROUP BY h.id)
SELECT k.id, k.zone_id, mode, CASE WHEN mode = 'coarsen' THEN round_even(lat, coalesce(decimal_places, 2)) WHEN mode <> 'strip' THEN lat END AS lat, CASE WHEN mode = 'coarsen' THEN round_even(lon, coalesce(decimal_places, 2)) WHEN mode <> 'strip' THEN lon END AS lon FROM k JOIN t USING (zone_id) JOIN p ON p.id = k.id""",
    "point_clusters": _DB + " SELECT id, cluster_id FROM x",
    "cluster_centres": _DB + """, y AS (SELECT x.cluster_id, p.* FROM x JOIN p USING (id) WHERE cluster_id IS NOT NULL), k AS (SELECT cluster_id, lower(trim(location_name)) AS name, count(*) AS k FROM y WHERE trim(location_name) <> '' GROUP BY 1, 2)
SELECT y.cluster_id, count(*) AS n, floor(sum(round(lat * 1000000)::BIGINT) / count(*))::BIGINT AS lat_micro, floor(sum(round(lon * 1000000)::BIGINT) / count(*))::BIGINT AS lon_micro, coalesce((SELECT arg_min(name, (-k.k, name)) FROM k WHERE k.cluster_id = y.cluster_id), 'cluster ' || y.cluster_id) AS name FROM y GROUP BY y.cluster_id""",
    "place_mentions": f"""WITH n AS (SELECT DISTINCT lower(trim(location_name)) AS name FROM {_P} WHERE length(trim(location_name)) > 3),
t AS (SELECT name, ' ' || array_to_string(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS k FROM n), d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS w FROM documents WHERE text IS NOT NULL)
SELECT name, count(*) AS n_docs FROM t JOIN d ON contains(d.w, t.k) WHERE length(trim(k)) > 0 GROUP BY name""",
    "usable_points": f"SELECT coalesce({_OK}, false) AS usable, count(*) AS n FROM {_P} GROUP BY 1",
}

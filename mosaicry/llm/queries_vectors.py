"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.llm.clusters import describe_groups, similar_vector_links, vector_groups
from mosaicry.llm.neighbours import nearest, unit_vectors
from mosaicry.operators.components import connected_components
from mosaicry.operators.graph import dbscan
from mosaicry.scratch import materialize
from mosaicry.tables import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = vector_groups(load(spark, d, "voice_speaker_clusters").select("id", "centroid"), "id", "centroid", 0.8)
    return g.select(F.col("id").alias("cluster_row_id"), "group_id")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each voice with its number of fragments, their spread and the most typical ones; loose groups are split."""
    rows = load(spark, d, "voice_speaker_clusters").select("id", "centroid").dropDuplicates(["id"])
    links = materialize(similar_vector_links(rows, "id", "centroid", 0.8), "links")
    groups = connected_components(links).withColumnsRenamed({"node": "id", "component": "group_id"})
    return describe_groups(rows, "id", "centroid", materialize(groups, "groups"), split=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    v = unit_vectors(load(spark, d, "file_voice_embeddings"), "file_id", "embedding", "model")
    n = nearest(v, v, k=5, min_cosine=0.7)
    return n.select(F.least("id", "other").alias("file_a"), F.greatest("id", "other").alias("file_b")).distinct()


def p4_speakers(spark: SparkSession, d: str) -> DataFrame:
    """For the voice segments whose id is divisible by 50, the three registered voices most like them."""
    seg = load(spark, d, "file_voice_segments").select("id", "embedding").filter("id % 50 = 0")
    # a segment and a person may share a number, so people are searched under negative ids
    base = unit_vectors(load(spark, d, "people").select((-F.col("id")).alias("id"), "voice_centroid"), "id", "voice_centroid")
    n = nearest(unit_vectors(seg, "id", "embedding"), base, k=3, min_cosine=0.5)
    return n.select(F.col("id").alias("segment_id"), (-F.col("other")).alias("person_id"), F.round("cosine", 6).alias("cosine"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """How well each older cluster label of files holds together: its files with a point, the clusters their points form now, and the share of the largest."""
    old = load(spark, d, "file_gps_cluster_assignments").filter("file_id IS NOT NULL AND cluster_id IS NOT NULL").select("file_id", "cluster_id").distinct()
    pts = load(spark, d, "gps_proposals").select("id", "file_id", "proposed_lat", "proposed_lon").dropDuplicates(["id"])
    now = dbscan(pts, "id", "proposed_lat", "proposed_lon", 300.0, 3).withColumn("place", F.coalesce("cluster_id", -F.col("id"))).select("id", "place")
    place = pts.join(now, "id").filter("file_id IS NOT NULL").groupBy("file_id", "place").agg(F.count("*").alias("n"))
    main = place.groupBy("file_id").agg(F.min_by("place", F.struct((-F.col("n")).alias("n"), "place")).alias("place"))
    size = old.join(main, "file_id").groupBy("cluster_id", "place").agg(F.count("*").alias("n"))
    g = size.groupBy("cluster_id").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_places"), F.max("n").alias("largest"))
    return g.select("cluster_id", "n_files", "n_places", (F.col("largest") / F.col("n_files")).alias("share"))


QUERIES = {"p2_labels": p2_labels, "p4_found": p4_found, "p4_speakers": p4_speakers, "p2_found": p2_found, "p2_clusters": p2_clusters}

_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"

ORACLE = {
    "p2_labels": f"""
WITH RECURSIVE q AS (SELECT DISTINCT ON (id) id, file_id, proposed_lat AS lat, proposed_lon AS lon FROM gps_proposals),
p AS (SELECT * FROM q WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.lat - b.lat) <= 0.003 AND {_DIST} <= 300),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3), e AS (SELECT a, b FROM n WHERE a IN (FROM core) AND b IN (FROM core)),
r AS (SELECT a AS node, a AS other FROM core UNION SELECT node, e.b FROM r JOIN e ON e.a = other), c AS (SELECT node, min(other) AS c FROM r GROUP BY node),
x AS (SELECT p.id, p.file_id, coalesce(c.c, (SELECT min(c2.c) FROM n JOIN c c2 ON c2.node = n.b WHERE n.a = p.id), -p.id) AS place FROM p LEFT JOIN c ON c.node = p.id),
k AS (SELECT file_id, place, count(*) AS n FROM x WHERE file_id IS NOT NULL GROUP BY 1, 2), m AS (SELECT file_id, arg_min(place, (-n, place)) AS place FROM k GROUP BY 1),
s AS (SELECT cluster_id, place, count(*) AS n FROM (SELECT DISTINCT file_id, cluster_id FROM file_gps_cluster_assignments WHERE cluster_id IS NOT NULL AND file_id IS NOT NULL) JOIN m USING (file_id) GROUP BY 1, 2)
SELECT cluster_id, sum(n)::BIGINT AS n_files, count(*) AS n_places, max(n) / sum(n)::DOUBLE AS share FROM s GROUP BY 1
""",
    "p4_found": """
WITH e AS (SELECT DISTINCT ON (file_id) file_id, model, embedding::DOUBLE[] AS v FROM file_voice_embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE NOT list_bool_or([isnan(x) for x in v]) AND list_sum([x * x for x in v]) > 0),
p AS (SELECT a.file_id AS a, b.file_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.model = b.model AND len(a.v) = len(b.v) AND a.file_id <> b.file_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p WHERE c >= 0.7)
SELECT DISTINCT least(a, b) AS file_a, greatest(a, b) AS file_b FROM t WHERE k <= 5
""",
    "p4_speakers": """
WITH q AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS v FROM file_voice_segments WHERE id % 50 = 0 AND embedding IS NOT NULL),
b AS (SELECT DISTINCT ON (id) id, voice_centroid::DOUBLE[] AS v FROM people WHERE voice_centroid IS NOT NULL),
p AS (SELECT q.id AS segment_id, b.id AS person_id, list_cosine_similarity(q.v, b.v) AS c FROM q JOIN b ON len(q.v) = len(b.v)
  WHERE list_sum([x * x for x in q.v]) > 0 AND list_sum([x * x for x in b.v]) > 0)
SELECT segment_id, person_id, round(c, 6) AS cosine FROM p WHERE c >= 0.5 QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY c DESC, person_id) <= 3
""",
    "p2_found": """
WITH RECURSIVE c AS (SELECT DISTINCT ON (id) id, centroid::DOUBLE[] AS v FROM voice_speaker_clusters WHERE centroid IS NOT NULL),
u AS (SELECT * FROM c WHERE list_sum([x * x for x in v]) > 0),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.8),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT node, e.b FROM r JOIN e ON e.a = other)
SELECT node AS cluster_row_id, min(other) AS group_id FROM r GROUP BY node
""",
}

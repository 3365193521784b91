"""Queries on people, voices, faces and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.functions.geo import box_to_pixels
from mosaicry.functions.text import STAMP, name_parts, stamp_ms, word_list
from mosaicry.functions.vectors import cosine, norm
from mosaicry.operators.facts import prefer, trimmed_centroids
from mosaicry.operators.graph import communities, npmi_edges
from mosaicry.operators.matching import best_overlap
from mosaicry.operators.ranking import distributed_rank, word_blocks
from mosaicry.operators.skew import left_join
from mosaicry.tables import load, once


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "transcript_segments"), "id")


def _voices(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "file_voice_segments").drop("embedding"), "id")


def segment_voices(spark: SparkSession, d: str) -> DataFrame:
    """For every unlabelled transcript segment, the voice segment of its file that it shares most time with."""
    s = _segments(spark, d).filter("speaker_label IS NULL")
    return best_overlap(s, _voices(spark, d).withColumnRenamed("id", "span_id"), "file_id").withColumnsRenamed({"id": "segment_id", "span_id": "voice_id"})


def voice_labels(spark: SparkSession, d: str) -> DataFrame:
    """What each voice segment is called: the person's name, else its cluster's label, else its own."""
    ppl = once(load(spark, d, "people"), "id").select(F.col("id").alias("person_id"), "preferred_name")
    cl = once(load(spark, d, "voice_speaker_clusters"), "id").select(F.col("id").alias("cluster_id"), F.col("label").alias("cluster_label"))
    v = left_join(left_join(_voices(spark, d), ppl, "person_id", "id"), cl, "cluster_id", "id")
    full = lambda c: F.when(F.trim(c) != "", F.col(c))
    return v.select("id", F.coalesce(full("preferred_name"), full("cluster_label"), "speaker_label").alias("label"))


def transcript_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 words of each file's whole text, each sharing 20 with the one before; segments without start_ms stand by the timestamp in their text, else last."""
    at = F.coalesce("start_ms", stamp_ms(F.col("text")))
    s = _segments(spark, d).select("file_id", "id", at.isNull().alias("late"), at.alias("at"), word_list(F.col("text")).alias("w"))
    return word_blocks(s.filter("file_id IS NOT NULL AND size(w) > 0"), "file_id", ["late", "at", "id"], "w", 200, 20)


def people_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each person with the number of their voice segments and voice clusters."""
    ppl = once(load(spark, d, "people"), "id").select("id", "preferred_name")
    v = _voices(spark, d).groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n_segments"))
    c = once(load(spark, d, "voice_speaker_clusters").select("id", "person_id"), "id").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n_clusters"))
    j = ppl.join(v, "id", "left").join(c, "id", "left")
    return j.select("id", "preferred_name", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))


def person_names(spark: SparkSession, d: str) -> DataFrame:
    p = once(load(spark, d, "people"), "id").filter("length(trim(preferred_name)) > 0")
    return p.withColumn("n", name_parts(F.col("preferred_name"))).select("id", F.col("n.first").alias("first"), F.col("n.middle").alias("middle"), F.col("n.last").alias("last"))


def face_regions(spark: SparkSession, d: str) -> DataFrame:
    """One region per file and name (case and blanks ignored), source mwg-rs first, with its box in a 4000 x 3000 image."""
    f = once(load(spark, d, "meta_face_regions"), "id").withColumn("who", F.lower(F.trim("name"))).filter("who <> ''")
    best = prefer(f, ["file_id", "who"], [F.col("source") != "mwg-rs", F.col("id")])
    b = F.col("bbox_norm")
    box = box_to_pixels(b[0], b[1], b[2], b[3], F.lit(4000), F.lit(3000))
    return best.withColumn("b", box).select("id", "file_id", "who", *[F.round(F.col(f"b.{c}"), 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


def face_people(spark: SparkSession, d: str) -> DataFrame:
    """Who the named faces are: a registered person of that name (the smallest id; case and blanks ignored), or a new one behind the register."""
    tidy = lambda c: F.lower(F.trim(c))
    f = once(load(spark, d, "meta_face_regions"), "id").select(tidy("name").alias("who")).filter("who <> ''").groupBy("who").agg(F.count("*").alias("n_regions"))
    p = load(spark, d, "people").select("id", tidy("preferred_name").alias("who"))
    top = p.agg(F.max("id")).first()[0] or 0
    j = f.join(p.filter("who <> ''").groupBy("who").agg(F.min("id").alias("person_id")), "who", "left")
    new = distributed_rank(j.filter("person_id IS NULL").drop("person_id"), [], [F.asc("who")]).select("who", "n_regions", (F.lit(top) + F.col("rank") + 1).alias("person_id"), F.lit(True).alias("is_new"))
    return j.filter("person_id IS NOT NULL").select("who", "n_regions", "person_id", F.lit(False).alias("is_new")).unionByName(new)


def voice_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The trimmed centroid of each person's voice segments: kept rows, spread, and length before normalising."""
    v = load(spark, d, "file_voice_segments").select("id", "person_id", "embedding")
    c = trimmed_centroids(v, "person_id", "id", "embedding")
    return c.select("person_id", "n", F.round("spread", 5).alias("spread"), F.round(norm(F.col("centroid")), 5).alias("length"))


def centroid_drift(spark: SparkSession, d: str) -> DataFrame:
    """How like each registered voice is to the trimmed centroid of its segments."""
    c = trimmed_centroids(load(spark, d, "file_voice_segments").select("id", "person_id", "embedding"), "person_id", "id", "embedding")
    p = once(load(spark, d, "people").select("id", "voice_centroid"), "id").filter("voice_centroid IS NOT NULL")
    return p.join(c, p["id"] == c["person_id"]).select("id", F.round(cosine(F.col("voice_centroid"), F.col("centroid")), 5).alias("cosine"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    c = once(load(spark, d, "file_contexts"), "file_id")
    return c.select("file_id", F.explode("vocab_terms").alias("t")).select("file_id", F.lower(F.trim("t")).alias("term")).filter("term <> ''")


def term_npmi(spark: SparkSession, d: str) -> DataFrame:
    """Terms that occur together more than by chance, among those in three files at least."""
    e = npmi_edges(_terms(spark, d), "file_id", "term", 0.1, 3)
    return e.select("term_a", "term_b", "n_ab", F.round("score", 6).alias("score"))


def term_communities(spark: SparkSession, d: str) -> DataFrame:
    return communities(npmi_edges(_terms(spark, d), "file_id", "term", 0.1, 3), "term_a", "term_b", "score")


QUERIES = {f.__name__: f for f in (segment_voices, voice_labels, transcript_windows, people_counts, person_names, face_regions, face_people, voice_centroids, centroid_drift, term_npmi, term_communities)}

_V = "(SELECT DISTINCT ON (id) id, file_id, start_ms, end_ms, speaker_label, cluster_id, person_id FROM file_voice_segments)"
#: Segments with the time ``at_ms``: start_ms, else the timestamp in the text.
TIMED = rf"""s AS (SELECT *, coalesce(start_ms, CASE WHEN regexp_matches(text, '{STAMP}') THEN ((coalesce(TRY_CAST(g[1] || g[5] AS BIGINT), 0) * 60 + (g[2] || g[6])::BIGINT) * 60 + (g[3] || g[7])::BIGINT) * 1000 + rpad(g[4] || g[8], 3, '0')::BIGINT END) AS at_ms
FROM (SELECT *, [{", ".join(f"regexp_extract(text, '{STAMP}', {i})" for i in range(1, 9))}] AS g FROM (SELECT DISTINCT ON (id) * FROM transcript_segments WHERE length(trim(text)) > 0)))"""
_TC = """WITH v AS (SELECT DISTINCT ON (id) id, person_id AS g, embedding::DOUBLE[] AS v FROM file_voice_segments WHERE person_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE list_sum([x * x for x in v]) > 0),
l1 AS (SELECT g, unnest(v) AS x, unnest(range(len(v))) AS i FROM u), c1 AS (SELECT g, list(x ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS x FROM l1 GROUP BY 1, 2) GROUP BY g),
r AS (SELECT u.*, row_number() OVER (PARTITION BY u.g ORDER BY round(1 - list_cosine_similarity(v, c), 12), id) AS k, count(*) OVER (PARTITION BY u.g) AS n FROM u JOIN c1 USING (g)),
t AS (SELECT * FROM r WHERE k <= n - floor(n * 0.1)),
l2 AS (SELECT g, unnest(v) AS x, unnest(range(len(v))) AS i FROM t), c2 AS (SELECT g, list(x ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS x FROM l2 GROUP BY 1, 2) GROUP BY g)"""

ORACLE = {
    "segment_voices": f"""WITH s AS (SELECT DISTINCT ON (id) * FROM transcript_segments), o AS (SELECT s.id AS segment_id, v.id AS voice_id, least(s.end_ms, v.end_ms) - greatest(s.start_ms, v.start_ms) AS o FROM s JOIN {_V} v USING (file_id) WHERE s.speaker_label IS NULL AND s.start_ms IS NOT NULL AND s.end_ms IS NOT NULL)
SELECT segment_id, arg_min(voice_id, (-o, voice_id)) AS voice_id, max(o) AS overlap_ms FROM o WHERE o > 0 GROUP BY 1""",
    "voice_labels": f"""SELECT v.id, coalesce(CASE WHEN trim(preferred_name) <> '' THEN preferred_name END, CASE WHEN trim(label) <> '' THEN label END, speaker_label) AS label FROM {_V} v
LEFT JOIN (SELECT DISTINCT ON (id) id, preferred_name FROM people) p ON p.id = v.person_id LEFT JOIN (SELECT DISTINCT ON (id) id, label FROM voice_speaker_clusters) c ON c.id = v.cluster_id""",
    "transcript_windows": rf"""WITH {TIMED}, t AS (SELECT file_id, list_filter(regexp_split_to_array(trim(string_agg(text, ' ' ORDER BY at_ms NULLS LAST, id)), '\s+'), lambda x: x <> '') AS w FROM s GROUP BY 1),
n AS (SELECT file_id, w, unnest(range(1, greatest(1, len(w) - 20) + 1, 180)) AS a FROM t WHERE len(w) > 0) SELECT file_id, (a - 1) // 180 AS no, array_to_string(w[a:a+199], ' ') AS window FROM n""",
    "people_counts": f"""SELECT p.id, preferred_name, coalesce(v.n, 0) AS n_segments, coalesce(c.n, 0) AS n_clusters FROM (SELECT DISTINCT ON (id) * FROM people) p LEFT JOIN (SELECT person_id, count(*) AS n FROM {_V} GROUP BY 1) v ON v.person_id = p.id
LEFT JOIN (SELECT person_id, count(DISTINCT id) AS n FROM voice_speaker_clusters GROUP BY 1) c ON c.person_id = p.id""",
    "person_names": r"""WITH p AS (SELECT DISTINCT ON (id) id, string_split(trim(regexp_replace(preferred_name, '\s+', ' ', 'g')), ' ') AS w FROM people WHERE length(trim(preferred_name)) > 0)
SELECT id, w[1] AS first, CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w)-1], ' ') END AS middle, CASE WHEN len(w) > 1 THEN w[len(w)] END AS last FROM p""",
    "face_regions": """WITH f AS (SELECT DISTINCT ON (id) *, lower(trim(name)) AS who FROM meta_face_regions), b AS (SELECT * FROM f WHERE who <> '' QUALIFY row_number() OVER (PARTITION BY file_id, who ORDER BY source <> 'mwg-rs', id) = 1)
SELECT id, file_id, who, round((bbox_norm[1] - bbox_norm[3] / 2) * 4000, 3) AS x1, round((bbox_norm[2] - bbox_norm[4] / 2) * 3000, 3) AS y1, round((bbox_norm[1] + bbox_norm[3] / 2) * 4000, 3) AS x2, round((bbox_norm[2] + bbox_norm[4] / 2) * 3000, 3) AS y2 FROM b""",
    "face_people": """WITH f AS (SELECT lower(trim(name)) AS who, count(*) AS n_regions FROM (SELECT DISTINCT ON (id) * FROM meta_face_regions) WHERE trim(name) <> '' GROUP BY 1), p AS (SELECT lower(trim(preferred_name)) AS who, min(id) AS pid FROM people WHERE trim(preferred_name) <> '' GROUP BY 1), j AS (SELECT who, n_regions, pid FROM f LEFT JOIN p USING (who))
SELECT who, n_regions, coalesce(pid, (SELECT max(id) FROM people) + row_number() OVER (PARTITION BY pid IS NULL ORDER BY who)) AS person_id, pid IS NULL AS is_new FROM j""",
    "voice_centroids": _TC + " SELECT t.g AS person_id, count(*) AS n, round(avg(1 - list_cosine_similarity(v, c)), 5) AS spread, 1.0::DOUBLE AS length FROM t JOIN c2 USING (g) GROUP BY t.g",
    "centroid_drift": _TC + " SELECT p.id, round(list_cosine_similarity(p.voice_centroid::DOUBLE[], c), 5) AS cosine FROM (SELECT DISTINCT ON (id) * FROM people) p JOIN c2 ON c2.g = p.id WHERE voice_centroid IS NOT NULL",
    "term_npmi": """WITH c AS (SELECT DISTINCT ON (file_id) * FROM file_contexts), f AS (SELECT DISTINCT file_id, lower(trim(t)) AS t FROM (SELECT file_id, unnest(vocab_terms) AS t FROM c) WHERE trim(t) <> ''), n AS (SELECT count(DISTINCT file_id)::DOUBLE AS n FROM f),
k AS (SELECT t, count(*) AS k FROM f GROUP BY t HAVING count(*) >= 3), p AS (SELECT a.t AS term_a, b.t AS term_b, count(*) AS n_ab FROM f a JOIN f b ON a.file_id = b.file_id AND a.t < b.t GROUP BY 1, 2),
s AS (SELECT term_a, term_b, n_ab, CASE WHEN n_ab = n THEN 1 ELSE ln(n_ab * n / (x.k * y.k)) / -ln(n_ab / n) END AS score FROM p JOIN k x ON x.t = term_a JOIN k y ON y.t = term_b, n) SELECT term_a, term_b, n_ab, round(score, 6) AS score FROM s WHERE score >= 0.1""",
}

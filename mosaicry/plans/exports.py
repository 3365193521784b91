"""Tables as they are handed on: facts with the paths of their files, registers and checks, and their CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.operators.ranking import distributed_rank
from mosaicry.operators.review import validated
from mosaicry.operators.scope import FileScope
from mosaicry.plans import places
from mosaicry.sources.registers import write_csv
from mosaicry.tables import load, once


def _files(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "files"), "id").select(F.col("id").alias("file_id"), "path", "sha256")


def _with_path(spark: SparkSession, d: str, facts: DataFrame, *cols: str | Column) -> DataFrame:
    return facts.filter("file_id IS NOT NULL").join(_files(spark, d).select("file_id", "path"), "file_id").select("file_id", "path", *cols)


def export_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Texts of files, blanks at their ends and blank ones left out."""
    t = load(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")
    return _with_path(spark, d, t, "doc_id", "kind", "text")


def export_summaries(spark: SparkSession, d: str) -> DataFrame:
    return export_descriptions(spark, d).filter("kind = 'summary'").drop("kind")


def export_tags(spark: SparkSession, d: str) -> DataFrame:
    c = once(load(spark, d, "file_contexts"), "file_id").select("file_id", F.explode("derived_tags").alias("tag"))
    return _with_path(spark, d, c.select("file_id", F.trim("tag").alias("tag")).filter("tag <> ''").distinct(), "tag")


def export_hashes(spark: SparkSession, d: str) -> DataFrame:
    """All files with their hashes, null where there are none."""
    h = load(spark, d, "file_hashes").select("file_id", "sha256_content", F.lower("phash").alias("phash"), F.lower("dhash").alias("dhash"), F.unix_micros("hashed_at").alias("hashed_us")).distinct()
    return _files(spark, d).join(h, "file_id", "left").select("file_id", "path", "sha256", "sha256_content", "phash", "dhash", "hashed_us")


def export_faces(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox_norm")
    r = once(load(spark, d, "meta_face_regions"), "id")
    return _with_path(spark, d, r, "id", "name", "source", *[b[i].alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def export_voice_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Voice vectors of files: their model, length and size; null vectors are left out."""
    e = load(spark, d, "file_voice_embeddings").filter("embedding IS NOT NULL").select("file_id", "model", "duration_ms", F.size("embedding").cast("long").alias("dims"))
    return _with_path(spark, d, e.distinct(), "model", "duration_ms", "dims")


def export_voice_segments(spark: SparkSession, d: str) -> DataFrame:
    v = once(load(spark, d, "file_voice_segments").drop("embedding"), "id")
    return _with_path(spark, d, v, "id", "segment_index", "start_ms", "end_ms", "speaker_label", "person_id", "cluster_id")


def export_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _with_path(spark, d, once(load(spark, d, "transcript_segments"), "id"), "id", "start_ms", "end_ms", "speaker_label", "text")


def export_geolabels(spark: SparkSession, d: str) -> DataFrame:
    """The region of each proposal's point with the path of its file."""
    g = once(load(spark, d, "gps_proposals").select("id", "file_id"), "id").join(places.region_labels(spark, d), "id")
    return _with_path(spark, d, g, "id", "country", "country_code", "state", "custom_name")


def export_location_labels(spark: SparkSession, d: str) -> DataFrame:
    """The nearest accepted place of each other proposal with the path of its file."""
    g = once(load(spark, d, "gps_proposals").select("id", "file_id"), "id").join(places.nearest_places(spark, d), "id")
    return _with_path(spark, d, g, "id", "place", "distance_m")


def export_gps_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Older cluster labels of files with the commonest name of the cluster; files without a cluster come last by ``place``."""
    a = load(spark, d, "file_gps_cluster_assignments").select("file_id", "cluster_id", "distance_m").distinct()
    n = load(spark, d, "gps_proposals").select("id", "file_id", F.lower(F.trim("location_name")).alias("name")).dropDuplicates(["id"]).filter("name <> ''")
    k = a.filter("cluster_id IS NOT NULL").select("file_id", "cluster_id").distinct().join(n, "file_id").groupBy("cluster_id", "name").agg(F.count("*").alias("k"))
    best = k.groupBy("cluster_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "name")).alias("b")).select("cluster_id", F.col("b.name").alias("label"))
    known, noise = a.filter("cluster_id IS NOT NULL").join(best, "cluster_id", "left"), a.filter("cluster_id IS NULL").withColumn("label", F.lit(None).cast("string"))
    t = _with_path(spark, d, known.unionByName(noise), "cluster_id", "label", "distance_m")
    return distributed_rank(t, [], [F.asc_nulls_last("label"), F.asc_nulls_last("cluster_id"), F.asc("file_id"), F.asc_nulls_first("distance_m")]).withColumnRenamed("rank", "place").drop("n")


def gps_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """The files of each older cluster by path, numbered, with the number of files."""
    a = load(spark, d, "file_gps_cluster_assignments").filter("cluster_id IS NOT NULL").select("file_id", "cluster_id").distinct()
    return distributed_rank(_with_path(spark, d, a, "cluster_id"), ["cluster_id"], [F.asc("path"), F.asc("file_id")]).withColumnsRenamed({"rank": "place", "n": "n_files"})


def _present(spark: SparkSession, d: str) -> DataFrame:
    """What the folders hold now, as far as the hash run saw it."""
    h = load(spark, d, "file_hashes").select("file_id", F.col("sha256_content").alias("now")).distinct()
    return h.join(_files(spark, d).select("file_id", "path"), "file_id").select("path", F.col("now").alias("sha256"))


def file_status(spark: SparkSession, d: str) -> DataFrame:
    """Every file compared with what the hash run found: ok, changed, moved or missing."""
    return validated(_files(spark, d).withColumnRenamed("file_id", "id"), _present(spark, d))


def export_validation(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not as recorded, with their paths."""
    return _with_path(spark, d, file_status(spark, d).filter("status <> 'ok'").withColumnRenamed("id", "file_id"), "status", "detail")


def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    s = file_status(spark, d)
    return s.agg(F.count("*").alias("checked"), *[F.count(F.when(F.col("status") == k, 1)).alias(k) for k in ("ok", "changed", "moved", "missing")])


NAME_FORMS = ("preferred_name", "title", "first_name", "middle_name", "last_name")


def export_people_names(spark: SparkSession, d: str) -> DataFrame:
    """Every form of every registered name."""
    p = once(load(spark, d, "people").select("id", *NAME_FORMS), "id")
    forms = F.array(*[F.struct(F.lit(c).alias("form"), F.trim(c).alias("name")) for c in NAME_FORMS])
    return p.select("id", F.explode(forms).alias("f")).select("id", "f.form", "f.name").filter("name <> ''")


def export_people(spark: SparkSession, d: str) -> DataFrame:
    """The register with the size of each voice centroid."""
    p = once(load(spark, d, "people"), "id")
    return p.select("id", "preferred_name", "family", "voice_samples", F.when(F.col("voice_centroid").isNotNull(), F.size("voice_centroid")).cast("long").alias("dims"), F.unix_micros("created_at").alias("created_us"))


def export_people_events(spark: SparkSession, d: str) -> DataFrame:
    """What is dated about people: their entry in the register and the first and last segment that is theirs."""
    p = once(load(spark, d, "people").select("id", "preferred_name", "created_at"), "id")
    v = once(load(spark, d, "file_voice_segments").select("id", "person_id", "processed_at"), "id").groupBy(F.col("person_id").alias("id")).agg(F.min("processed_at").alias("first"), F.max("processed_at").alias("last"))
    e = F.array(*[F.struct(F.lit(k).alias("event"), F.date_format(c, "yyyy-MM-dd").alias("date")) for k, c in (("registered", "created_at"), ("first heard", "first"), ("last heard", "last"))])
    return p.join(v, "id", "left").select("id", "preferred_name", F.explode(e).alias("e")).select("id", "preferred_name", "e.event", "e.date").filter("date IS NOT NULL")


def speaker_cluster_samples(spark: SparkSession, d: str) -> DataFrame:
    """Voice clusters without a person, with their first segment that has a vector and its file."""
    c = once(load(spark, d, "voice_speaker_clusters").select("id", "label", "member_count", "person_id"), "id").filter("person_id IS NULL")
    s = load(spark, d, "file_voice_segments").filter("embedding IS NOT NULL AND cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min_by(F.struct("id", "file_id"), "id").alias("s"))
    j = c.join(s, c["id"] == s["cluster_id"], "left").select("id", "label", "member_count", F.col("s.id").alias("segment_id"), F.col("s.file_id").alias("file_id"))
    return j.join(_files(spark, d).select("file_id", "path"), "file_id", "left").select("id", "label", "member_count", "segment_id", "path")


def cluster_best_members(spark: SparkSession, d: str) -> DataFrame:
    """The most similar segment of each voice cluster (ties and unknown similarities: the smaller id) and its file."""
    s = once(load(spark, d, "file_voice_segments").drop("embedding"), "id").filter("cluster_id IS NOT NULL")
    known = F.when(~F.isnan("similarity"), F.col("similarity"))
    b = s.groupBy("cluster_id").agg(F.min_by(F.struct("id", "file_id", "similarity"), F.struct(known.isNull().alias("n"), (-known).alias("s"), "id")).alias("b"))
    b = b.select("cluster_id", F.col("b.id").alias("segment_id"), F.col("b.file_id").alias("file_id"), F.round("b.similarity", 6).alias("similarity"))
    return b.join(_files(spark, d).select("file_id", "path"), "file_id", "left").select("cluster_id", "segment_id", "similarity", "path")


EXPORTS = {
    f.__name__: f
    for f in (
        export_descriptions, export_summaries, export_tags, export_hashes, export_faces, export_voice_embeddings, export_voice_segments, export_transcripts, export_geolabels, export_location_labels,
        export_gps_clusters, export_validation, export_people_names, export_people, export_people_events,
    )
}


def export_all(spark: SparkSession, d: str, folder: str, scope: FileScope | None = None) -> list[str]:
    """Write every export as CSV files under ``folder``, those of files for the files in scope only; the names written."""
    keep = None if scope is None or scope.is_empty() else once(load(spark, d, "files"), "id").filter(scope.condition()).select(F.col("id").alias("file_id"))
    for name, query in EXPORTS.items():
        df = query(spark, d)
        if keep is not None and "file_id" in df.columns:
            df = df.join(keep, "file_id", "left_semi")
        write_csv(df, f"{folder}/{name.removeprefix('export_')}")
    return list(EXPORTS)


QUERIES = EXPORTS | {f.__name__: f for f in (gps_cluster_members, file_status, validation_counts, speaker_cluster_samples, cluster_best_members)}

_F = "(SELECT DISTINCT ON (id) id AS file_id, path, sha256 FROM files)"
_SEG = "(SELECT DISTINCT ON (id) * EXCLUDE (embedding) FROM file_voice_segments)"
_DOCS = rf"SELECT file_id, path, doc_id, kind, text FROM (SELECT doc_id, file_id, kind, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents) JOIN {_F} USING (file_id) WHERE text <> ''"
_STATUS = f"""f AS (SELECT * FROM {_F}), p AS (SELECT path, max(sha256_content) AS now FROM file_hashes h JOIN f USING (file_id) GROUP BY 1),
x AS (SELECT f.file_id, f.path, f.sha256, now, p.path IS NOT NULL AS there FROM f LEFT JOIN p USING (path)), o AS (SELECT sha256, min(path) AS elsewhere FROM x WHERE there AND sha256 IS NOT NULL GROUP BY 1),
s AS (SELECT file_id, path, CASE WHEN there AND (sha256 IS NULL OR now IS NULL OR now = sha256) THEN 'ok' WHEN there THEN 'changed' WHEN elsewhere IS NOT NULL THEN 'moved' ELSE 'missing' END AS status,
  CASE WHEN there AND now <> sha256 THEN now WHEN NOT there THEN elsewhere END AS detail FROM x LEFT JOIN o USING (sha256))"""

ORACLE = {
    "export_descriptions": _DOCS,
    "export_summaries": f"SELECT file_id, path, doc_id, text FROM ({_DOCS}) WHERE kind = 'summary'",
    "export_tags": f"SELECT DISTINCT file_id, path, trim(tag) AS tag FROM (SELECT file_id, unnest(derived_tags) AS tag FROM (SELECT DISTINCT ON (file_id) * FROM file_contexts)) JOIN {_F} USING (file_id) WHERE trim(tag) <> ''",
    "export_hashes": f"SELECT f.file_id, path, sha256, sha256_content, lower(phash) AS phash, lower(dhash) AS dhash, epoch_us(hashed_at) AS hashed_us FROM {_F} f LEFT JOIN (SELECT DISTINCT * FROM file_hashes) h USING (file_id)",
    "export_faces": f"SELECT file_id, path, id, name, source, bbox_norm[1] AS cx, bbox_norm[2] AS cy, bbox_norm[3] AS w, bbox_norm[4] AS h FROM (SELECT DISTINCT ON (id) * FROM meta_face_regions) JOIN {_F} USING (file_id)",
    "export_voice_embeddings": f"SELECT DISTINCT file_id, path, model, duration_ms, len(embedding) AS dims FROM file_voice_embeddings JOIN {_F} USING (file_id) WHERE embedding IS NOT NULL",
    "export_voice_segments": f"SELECT file_id, path, id, segment_index, start_ms, end_ms, speaker_label, person_id, cluster_id FROM {_SEG} JOIN {_F} USING (file_id)",
    "export_transcripts": f"SELECT file_id, path, id, start_ms, end_ms, speaker_label, text FROM (SELECT DISTINCT ON (id) * FROM transcript_segments) JOIN {_F} USING (file_id)",
    "export_geolabels": f"SELECT file_id, path, g.id, country, country_code, state, custom_name FROM (SELECT DISTINCT ON (id) id, file_id FROM gps_proposals) g JOIN ({places.ORACLE['region_labels']}) r USING (id) JOIN {_F} USING (file_id)",
    "export_location_labels": f"SELECT file_id, path, g.id, place, distance_m FROM (SELECT DISTINCT ON (id) id, file_id FROM gps_proposals) g JOIN ({places.ORACLE['nearest_places']}) r USING (id) JOIN {_F} USING (file_id)",
    "export_gps_clusters": f"""WITH a AS (SELECT DISTINCT file_id, cluster_id, distance_m FROM file_gps_cluster_assignments), n AS (SELECT DISTINCT ON (id) id, file_id, lower(trim(location_name)) AS name FROM gps_proposals),
k AS (SELECT cluster_id, name, count(*) AS k FROM (SELECT DISTINCT file_id, cluster_id FROM a WHERE cluster_id IS NOT NULL) JOIN n USING (file_id) WHERE name <> '' GROUP BY 1, 2), b AS (SELECT cluster_id, arg_min(name, (-k, name)) AS label FROM k GROUP BY 1)
SELECT file_id, path, cluster_id, label, distance_m, row_number() OVER (ORDER BY label NULLS LAST, cluster_id NULLS LAST, file_id, distance_m NULLS FIRST) - 1 AS place FROM a LEFT JOIN b USING (cluster_id) JOIN {_F} USING (file_id)""",
    "gps_cluster_members": f"SELECT file_id, path, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY path, file_id) - 1 AS place, count(*) OVER (PARTITION BY cluster_id) AS n_files FROM (SELECT DISTINCT file_id, cluster_id FROM file_gps_cluster_assignments WHERE cluster_id IS NOT NULL) JOIN {_F} USING (file_id)",
    "file_status": f"WITH {_STATUS} SELECT file_id AS id, status, detail FROM s",
    "export_validation": f"WITH {_STATUS} SELECT file_id, path, status, detail FROM s WHERE status <> 'ok'",
    "validation_counts": f"WITH {_STATUS} SELECT count(*) AS checked, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'missing') AS missing FROM s",
    "export_people_names": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS form, trim({c}) AS name FROM (SELECT DISTINCT ON (id) * FROM people)" for c in NAME_FORMS) + ") WHERE name <> ''",
    "export_people": "SELECT id, preferred_name, family, voice_samples, len(voice_centroid) AS dims, epoch_us(created_at) AS created_us FROM (SELECT DISTINCT ON (id) * FROM people)",
    "export_people_events": f"""WITH p AS (SELECT DISTINCT ON (id) id, preferred_name, created_at FROM people), v AS (SELECT person_id AS id, min(processed_at) AS a, max(processed_at) AS b FROM {_SEG} GROUP BY 1), j AS (SELECT * FROM p LEFT JOIN v USING (id)),
e AS (SELECT id, preferred_name, 'registered' AS event, created_at AS t FROM j UNION ALL SELECT id, preferred_name, 'first heard', a FROM j UNION ALL SELECT id, preferred_name, 'last heard', b FROM j)
SELECT id, preferred_name, event, strftime(t, '%Y-%m-%d') AS date FROM e WHERE t IS NOT NULL""",
    "speaker_cluster_samples": f"""WITH c AS (SELECT DISTINCT ON (id) id, label, member_count, person_id FROM voice_speaker_clusters), s AS (SELECT cluster_id, min(id) AS segment_id, arg_min(file_id, id) AS file_id FROM file_voice_segments WHERE embedding IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1)
SELECT c.id, label, member_count, segment_id, path FROM c LEFT JOIN s ON s.cluster_id = c.id LEFT JOIN {_F} f USING (file_id) WHERE person_id IS NULL""",
    "cluster_best_members": f"""WITH b AS (SELECT cluster_id, id AS segment_id, file_id, similarity FROM {_SEG} WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN isnan(similarity) THEN NULL ELSE similarity END DESC NULLS LAST, id) = 1)
SELECT cluster_id, segment_id, round(similarity, 6) AS similarity, path FROM b LEFT JOIN {_F} USING (file_id)""",
}

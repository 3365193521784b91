"""What is still to be done and what was decided: open work by stage, terms under review, pages, counts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.functions.geo import usable_point
from mosaicry.functions.text import normal_name, path_tokens, token_class
from mosaicry.operators.ranking import distributed_rank
from mosaicry.operators.review import counted_terms, decisions, done_counts, merged_taxonomy, page, path_tree, status_counts, taxonomy
from mosaicry.operators.rules import standard_rules
from mosaicry.operators.scope import FileScope, having_any, originals, pending
from mosaicry.plans.records import STAGES
from mosaicry.tables import load, once

#: When each stage last wrote a row.
STAMPS = {"file_hashes": "hashed_at", "file_aesthetic": "scored_at", "gps_proposals": "proposed_at", "file_voice_segments": "processed_at", "file_voice_embeddings": "processed_at"}


def _files(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "files"), "id")


def pending_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Files without a context."""
    return pending(_files(spark, d), load(spark, d, "file_contexts")).select("id", "path")


def files_with_context(spark: SparkSession, d: str) -> DataFrame:
    return having_any(_files(spark, d), load(spark, d, "file_contexts")).select("id", "path")


def pending_fields(spark: SparkSession, d: str) -> DataFrame:
    """Files that have a context but no place proposed."""
    return pending(having_any(_files(spark, d), load(spark, d, "file_contexts")), load(spark, d, "gps_proposals")).select("id")


def pending_frame_hash(spark: SparkSession, d: str) -> DataFrame:
    """Videos whose hash row is missing or lacks the picture hash."""
    return pending(_files(spark, d).filter("file_type = 'video'"), load(spark, d, "file_hashes").filter("phash IS NOT NULL")).select("id", "path")


def pending_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Original sound and video without any words."""
    words = load(spark, d, "transcript_segments").filter("length(trim(text)) > 0")
    return pending(originals(_files(spark, d)).filter("file_type IN ('audio', 'video')"), words).select("id")


def pending_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Original pictures without a description or caption that holds words."""
    texts = load(spark, d, "documents").filter("kind IN ('description', 'caption') AND length(trim(text)) > 0")
    return pending(originals(_files(spark, d)).filter("file_type = 'image'"), texts).select("id")


def pending_places(spark: SparkSession, d: str) -> DataFrame:
    """Files of which every proposal still waits: none accepted or rejected, or none at all."""
    done = load(spark, d, "gps_proposals").select("file_id", F.lower(F.trim("status")).alias("status"))
    return pending(_files(spark, d), done, retry=("pending", "")).select("id")


def pending_scores(spark: SparkSession, d: str) -> DataFrame:
    """Original pictures and videos without a valid score of any model."""
    done = load(spark, d, "file_aesthetic").filter(F.col("score").between(0, 1))
    return pending(originals(_files(spark, d)).filter("file_type IN ('image', 'video')"), done).select("id")


def pending_face_regions(spark: SparkSession, d: str) -> DataFrame:
    return pending(_files(spark, d).filter("file_type = 'image'"), load(spark, d, "meta_face_regions").filter("source = 'mwg-rs'")).select("id")


def pending_meta_faces(spark: SparkSession, d: str) -> DataFrame:
    """Pictures without any named face."""
    return pending(_files(spark, d).filter("file_type = 'image'"), load(spark, d, "meta_face_regions").filter("length(trim(name)) > 0")).select("id")


def pending_voice_segments(spark: SparkSession, d: str) -> DataFrame:
    return pending(_files(spark, d).filter("file_type IN ('audio', 'video')"), load(spark, d, "file_voice_segments")).select("id")


def pending_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Files with a segment of unknown speaker and a voice segment to tell it by."""
    unknown = having_any(_files(spark, d), load(spark, d, "transcript_segments").filter("speaker_label IS NULL"))
    return having_any(unknown, load(spark, d, "file_voice_segments")).select("id")


def pending_location_labels(spark: SparkSession, d: str) -> DataFrame:
    """Original files with a usable point and no cluster yet."""
    pts = load(spark, d, "gps_proposals").filter(usable_point(F.col("proposed_lat"), F.col("proposed_lon")))
    return pending(having_any(originals(_files(spark, d)), pts), load(spark, d, "file_gps_cluster_assignments").filter("cluster_id IS NOT NULL")).select("id")


def located_files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "gps_proposals").filter("file_id IS NOT NULL").filter(usable_point(F.col("proposed_lat"), F.col("proposed_lon"))).select(F.col("file_id").alias("id")).distinct()


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """Files hashed before they were last changed, or never."""
    h = load(spark, d, "file_hashes").groupBy(F.col("file_id").alias("id")).agg(F.max("hashed_at").alias("at"))
    return _files(spark, d).join(h, "id", "left").filter(F.col("at").isNull() | (F.timestamp_seconds("mtime") > F.col("at"))).select("id", "path")


def scope_counts(spark: SparkSession, d: str) -> DataFrame:
    """Saved scopes with the number of files in each now, counted in one pass."""
    scopes = {"pictures": FileScope(file_type="image"), "archive before 2010": FileScope(folder_prefix="/archive", date_to="2009-12-31"), "scans of source 1": FileScope(source_id=1, name_pattern="scan*"), "all": FileScope()}
    n = F.array(*[F.struct(F.lit(k).alias("scope"), F.lit(s.summary()).alias("summary"), s.condition().alias("hit")) for k, s in scopes.items()])
    t = _files(spark, d).select(F.explode(n).alias("s")).select("s.scope", "s.summary", "s.hit")
    return t.groupBy("scope", "summary").agg(F.count(F.when(F.col("hit"), 1)).alias("n_files"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Terms of files that wait for a decision: (file_id, term, source)."""
    c = once(load(spark, d, "file_contexts"), "file_id")
    part = lambda col, s: c.select("file_id", F.explode(col).alias("t"), F.lit(s).alias("source"))
    return part("derived_tags", "tags").unionByName(part("vocab_terms", "vocabulary")).select("file_id", F.lower(F.trim("t")).alias("term"), "source").filter("term <> ''")


def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its number of files, the first of them and its source."""
    return counted_terms(_candidates(spark, d), "term", "file_id", ["file_id", "source"])


def term_page(spark: SparkSession, d: str) -> DataFrame:
    """The second fifty terms by number of files (a page of a review)."""
    return page(term_candidates(spark, d), [F.desc("file_count"), F.asc("term")], 50, 50)


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct place names in all and by what became of them."""
    g = load(spark, d, "gps_proposals").select(normal_name(F.col("location_name")).alias("name"), F.lower(F.trim("status")).alias("status")).filter("name <> ''")
    return status_counts(g, "name", "status", {"pending": ["pending"], "accepted": ["accepted"], "rejected": ["rejected", "corrected"]})


def decided_names(spark: SparkSession, d: str) -> DataFrame:
    """Place names that were decided on, with the first status by alphabet."""
    g = once(load(spark, d, "gps_proposals"), "id").select(normal_name(F.col("location_name")).alias("name"), F.lower(F.trim("status")).alias("status")).filter("name <> '' AND status <> 'pending'")
    return g.groupBy("name").agg(F.min("status").alias("status"), F.count("*").alias("n"))


def has_open_candidates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "gps_proposals").agg(F.coalesce(F.max(F.lower(F.trim("status")) == "pending"), F.lit(False)).alias("open"))


def file_term_sets(spark: SparkSession, d: str) -> DataFrame:
    """The set of terms of each file, sorted."""
    return _candidates(spark, d).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))


def token_review_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of file names in all, and those nothing is known about."""
    t = _files(spark, d).select(F.explode(path_tokens(F.col("filename"))).alias("token")).distinct()
    return t.agg(F.count("*").alias("total"), F.count(F.when(token_class(F.col("token"))["semantic_type"] == "unclassified", 1)).alias("pending"))


def token_page(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty tokens of file names by number of files."""
    t = _files(spark, d).select("id", F.explode(path_tokens(F.col("filename"))).alias("token"))
    return page(counted_terms(t, "token", "id"), [F.desc("file_count"), F.asc("term")], 50)


def description_counts(spark: SparkSession, d: str) -> DataFrame:
    return done_counts(_files(spark, d).filter("file_type = 'image'"), load(spark, d, "documents").filter("length(trim(text)) > 0 AND file_id IS NOT NULL"))


def transcription_counts(spark: SparkSession, d: str) -> DataFrame:
    return done_counts(_files(spark, d).filter("file_type IN ('audio', 'video')"), load(spark, d, "transcript_segments").filter("length(trim(text)) > 0"))


def all_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What was decided about places, voices and faces, in one form."""
    g = once(load(spark, d, "gps_proposals"), "id").withColumn("s", F.lower(F.trim("status"))).filter("s IN ('accepted', 'rejected')")
    v = once(load(spark, d, "voice_speaker_clusters").drop("centroid"), "id").filter("person_id IS NOT NULL")
    f = once(load(spark, d, "meta_face_regions"), "id").filter("length(trim(name)) > 0")
    return decisions(
        ("gps_proposals", g, F.trim("location_name"), F.col("s"), F.col("source_text")),
        ("voice_speaker_clusters", v, F.trim("label"), F.lit("assign"), F.col("person_id").cast("string")),
        ("meta_face_regions", f, F.trim("name"), F.lit("name"), F.col("source")),
    )


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(r["category"], r["result_tag"]) for r in standard_rules()], "category string, tag string")
    r = once(load(spark, d, "region_records"), "region_id")
    p = once(load(spark, d, "people").select("id", "preferred_name"), "id")
    none = F.lit(None).cast("string")
    return taxonomy(("Tags", rules, F.initcap("category"), F.col("tag")), ("Regions", r, F.col("level"), F.coalesce(F.when(F.trim("custom_name") != "", F.col("custom_name")), F.when(F.trim("state") != "", F.col("state")), "country")), ("People", p, none, F.col("preferred_name")))


def region_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Regions by level and people as sections of a taxonomy (the tags of the rules are checked by tests)."""
    return _taxonomy(spark, d).filter("section <> 'Tags'")


def grown_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """The regions' taxonomy as the country level has it, with the other levels merged in behind."""
    t = _taxonomy(spark, d).filter("section = 'Regions'").select("section", F.lit("all").alias("branch"), "leaf", "branch")
    t = t.toDF("section", "branch", "leaf", "level")
    old = distributed_rank(t.filter("level = 'country'").select("section", "branch", "leaf").distinct(), ["section", "branch"], [F.asc("leaf")]).select("section", "branch", "leaf", F.col("rank").alias("place"))
    return merged_taxonomy(old, t.filter("level <> 'country'").select("section", "branch", "leaf").distinct())


def tag_tree(spark: SparkSession, d: str) -> DataFrame:
    """Tags of two or three parts as a tree."""
    c = once(load(spark, d, "file_contexts"), "file_id").select(F.explode("derived_tags").alias("t"))
    return path_tree(c.select(F.lower(F.trim("t")).alias("t")), "t", ":")


def stage_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """How far each stage has come: its files, its share of all files in percent and its last row."""
    total = max(_files(spark, d).count(), 1)
    out = None
    for t in STAGES:
        at = F.max(F.unix_micros(STAMPS[t])) if t in STAMPS else F.lit(None).cast("bigint")
        n = load(spark, d, t).agg(F.lit(t).alias("stage"), F.countDistinct("file_id").alias("n_files"), at.alias("last_us"))
        out = n if out is None else out.unionByName(n)
    return out.select("stage", "n_files", F.floor(100 * F.col("n_files") / F.lit(total)).alias("percent"), "last_us")


def latest_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The last file taken in from each source (equal times: the larger id)."""
    f = _files(spark, d).filter("source_id IS NOT NULL")
    g = f.groupBy("source_id").agg(F.max_by(F.struct("id", "path", "ingested_at"), F.struct("ingested_at", "id")).alias("b"), F.count("*").alias("n_files"))
    return g.select("source_id", "n_files", F.col("b.id").alias("id"), F.col("b.path").alias("path"), F.unix_micros("b.ingested_at").alias("ingested_us"))


def voice_cluster_list(spark: SparkSession, d: str) -> DataFrame:
    """Voice clusters by their size, unknown sizes last, numbered."""
    c = once(load(spark, d, "voice_speaker_clusters").select("id", "label", "member_count", "person_id"), "id")
    return distributed_rank(c, [], [F.desc_nulls_last("member_count"), F.asc("id")]).withColumnRenamed("rank", "place").drop("n")


def proposal_list(spark: SparkSession, d: str) -> DataFrame:
    """Proposals that wait, by time and id, numbered."""
    g = once(load(spark, d, "gps_proposals"), "id").filter("lower(trim(status)) = 'pending'").select("id", "location_name", F.unix_micros("proposed_at").alias("proposed_us"))
    return distributed_rank(g, [], [F.asc_nulls_first("proposed_us"), F.asc("id")]).withColumnRenamed("rank", "place").drop("n")


QUERIES = {
    f.__name__: f
    for f in (
        pending_contexts, files_with_context, pending_fields, pending_frame_hash, pending_transcripts, pending_descriptions, pending_places, pending_scores, pending_face_regions, pending_meta_faces,
        pending_voice_segments, pending_attribution, pending_location_labels, located_files, stale_files, scope_counts, term_candidates, term_page, candidate_counts, decided_names, has_open_candidates,
        file_term_sets, token_review_counts, token_page, description_counts, transcription_counts, all_decisions, region_taxonomy, grown_taxonomy, tag_tree, stage_checkpoints, latest_ingest,
        voice_cluster_list, proposal_list,
    )
}

_F = "(SELECT DISTINCT ON (id) * FROM files)"
_IN = "f.id IN (SELECT file_id FROM {t} WHERE file_id IS NOT NULL)"
_OUT = "f.id NOT IN (SELECT file_id FROM {t} WHERE file_id IS NOT NULL AND {c})"
_AV, _IMG, _ORIG = "file_type IN ('audio', 'video')", "file_type = 'image'", "canonical_id IS NULL"
_POINT = "abs(proposed_lat) <= 90 AND abs(proposed_lon) <= 180 AND NOT (proposed_lat = 0 AND proposed_lon = 0)"
_WORDS = "length(trim(text)) > 0"
_CAND = """c AS (SELECT DISTINCT ON (file_id) * FROM file_contexts), t AS (SELECT file_id, lower(trim(x)) AS term, s AS source FROM (SELECT file_id, unnest(derived_tags) AS x, 'tags' AS s FROM c UNION ALL SELECT file_id, unnest(vocab_terms), 'vocabulary' FROM c) WHERE trim(x) <> '')"""
_NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_TOK = r"""list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(filename, '[/\\.]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[-_\s]+'), lambda x: lower(trim(x))), lambda x: x <> ''))"""
_TOKENS = f"(SELECT id, unnest({_TOK}) AS token FROM {_F})"
_REGIONS = "SELECT 'Regions' AS section, trim(level) AS branch, trim(coalesce(CASE WHEN trim(custom_name) <> '' THEN custom_name END, CASE WHEN trim(state) <> '' THEN state END, country)) AS leaf FROM (SELECT DISTINCT ON (region_id) * FROM region_records)"

ORACLE = {
    "pending_contexts": f"SELECT id, path FROM {_F} f WHERE {_OUT.format(t='file_contexts', c='true')}",
    "files_with_context": f"SELECT id, path FROM {_F} f WHERE {_IN.format(t='file_contexts')}",
    "pending_fields": f"SELECT id FROM {_F} f WHERE {_IN.format(t='file_contexts')} AND {_OUT.format(t='gps_proposals', c='true')}",
    "pending_frame_hash": f"SELECT id, path FROM {_F} f WHERE file_type = 'video' AND {_OUT.format(t='file_hashes', c='phash IS NOT NULL')}",
    "pending_transcripts": f"SELECT id FROM {_F} f WHERE {_ORIG} AND {_AV} AND {_OUT.format(t='transcript_segments', c=_WORDS)}",
    "pending_descriptions": f"""SELECT id FROM {_F} f WHERE {_ORIG} AND {_IMG} AND {_OUT.format(t='documents', c=f"kind IN ('description', 'caption') AND {_WORDS}")}""",
    "pending_places": f"""SELECT id FROM {_F} f WHERE {_OUT.format(t='gps_proposals', c="coalesce(lower(trim(status)), '') NOT IN ('pending', '')")}""",
    "pending_scores": f"SELECT id FROM {_F} f WHERE {_ORIG} AND file_type IN ('image', 'video') AND {_OUT.format(t='file_aesthetic', c='score BETWEEN 0 AND 1')}",
    "pending_face_regions": f"""SELECT id FROM {_F} f WHERE {_IMG} AND {_OUT.format(t='meta_face_regions', c="source = 'mwg-rs'")}""",
    "pending_meta_faces": f"SELECT id FROM {_F} f WHERE {_IMG} AND {_OUT.format(t='meta_face_regions', c='length(trim(name)) > 0')}",
    "pending_voice_segments": f"SELECT id FROM {_F} f WHERE {_AV} AND {_OUT.format(t='file_voice_segments', c='true')}",
    "pending_attribution": f"SELECT id FROM {_F} f WHERE f.id IN (SELECT file_id FROM transcript_segments WHERE speaker_label IS NULL) AND {_IN.format(t='file_voice_segments')}",
    "pending_location_labels": f"SELECT id FROM {_F} f WHERE {_ORIG} AND f.id IN (SELECT file_id FROM gps_proposals WHERE {_POINT}) AND {_OUT.format(t='file_gps_cluster_assignments', c='cluster_id IS NOT NULL')}",
    "located_files": f"SELECT DISTINCT file_id AS id FROM gps_proposals WHERE file_id IS NOT NULL AND {_POINT}",
    "stale_files": f"SELECT id, path FROM {_F} f LEFT JOIN (SELECT file_id, max(hashed_at) AS at FROM file_hashes GROUP BY 1) h ON h.file_id = f.id WHERE h.at IS NULL OR to_timestamp(mtime) > h.at",
    "scope_counts": f"""SELECT 'pictures' AS scope, 'file type: image' AS summary, count(*) FILTER (file_type = 'image') AS n_files FROM {_F}
UNION ALL SELECT 'archive before 2010', 'folder prefix: /archive · date to: 2009-12-31', count(*) FILTER (lower(path) LIKE '/archive/%' AND to_timestamp(mtime)::DATE <= DATE '2009-12-31') FROM {_F}
UNION ALL SELECT 'scans of source 1', 'source id: 1 · name pattern: scan*', count(*) FILTER (source_id = 1 AND filename ILIKE 'scan%') FROM {_F} UNION ALL SELECT 'all', '', count(*) FROM {_F}""",
    "term_candidates": f"WITH {_CAND} SELECT term, count(DISTINCT file_id) AS file_count, min(file_id) AS file_id, min(source) AS source FROM t GROUP BY term",
    "term_page": f"WITH {_CAND}, g AS (SELECT term, count(DISTINCT file_id) AS file_count, min(file_id) AS file_id, min(source) AS source FROM t GROUP BY term) SELECT *, row_number() OVER (ORDER BY file_count DESC, term) - 1 AS place FROM g ORDER BY place LIMIT 50 OFFSET 50",
    "candidate_counts": f"""WITH g AS (SELECT {_NORM.format(c='location_name')} AS name, lower(trim(status)) AS s FROM gps_proposals) SELECT count(DISTINCT name) AS total, count(DISTINCT name) FILTER (s = 'pending') AS pending, count(DISTINCT name) FILTER (s = 'accepted') AS accepted,
count(DISTINCT name) FILTER (s IN ('rejected', 'corrected')) AS rejected FROM g WHERE name <> ''""",
    "decided_names": f"WITH g AS (SELECT {_NORM.format(c='location_name')} AS name, lower(trim(status)) AS status FROM (SELECT DISTINCT ON (id) * FROM gps_proposals)) SELECT name, min(status) AS status, count(*) AS n FROM g WHERE name <> '' AND status <> 'pending' GROUP BY name",
    "has_open_candidates": "SELECT coalesce(bool_or(lower(trim(status)) = 'pending'), false) AS open FROM gps_proposals",
    "file_term_sets": f"WITH {_CAND} SELECT file_id, array_to_string(list_sort(list(DISTINCT term)), '|') AS terms FROM t GROUP BY file_id",
    "token_review_counts": rf"SELECT count(*) AS total, count(*) FILTER (NOT regexp_matches(token, '^[a-z0-9]+$') OR (regexp_matches(token, '^\d{{8}}$') AND NOT (TRY_CAST(token[1:4] AS INT) BETWEEN 1900 AND 2099 AND TRY_CAST(token[5:6] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(token[7:8] AS INT) BETWEEN 1 AND 31)) OR (regexp_matches(token, '^\d{{6}}$') AND NOT (TRY_CAST(token[3:4] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(token[5:6] AS INT) BETWEEN 1 AND 31) AND NOT (TRY_CAST(token[1:2] AS INT) <= 23 AND TRY_CAST(token[3:4] AS INT) <= 59))) AS pending FROM (SELECT DISTINCT token FROM {_TOKENS})",
    "token_page": f"WITH g AS (SELECT token AS term, count(DISTINCT id) AS file_count FROM {_TOKENS} GROUP BY 1) SELECT *, row_number() OVER (ORDER BY file_count DESC, term) - 1 AS place FROM g ORDER BY place LIMIT 50",
    "description_counts": f"SELECT count(*) AS total, count(*) FILTER (x) AS done, count(*) FILTER (NOT x) AS pending FROM (SELECT id IN (SELECT file_id FROM documents WHERE {_WORDS} AND file_id IS NOT NULL) AS x FROM {_F} WHERE {_IMG})",
    "transcription_counts": f"SELECT count(*) AS total, count(*) FILTER (x) AS done, count(*) FILTER (NOT x) AS pending FROM (SELECT id IN (SELECT file_id FROM transcript_segments WHERE {_WORDS}) AS x FROM {_F} WHERE {_AV})",
    "all_decisions": """SELECT 'gps_proposals:' || id AS id, trim(location_name) AS token, lower(trim(status)) AS action, coalesce(source_text, '') AS detail FROM (SELECT DISTINCT ON (id) * FROM gps_proposals) WHERE lower(trim(status)) IN ('accepted', 'rejected')
UNION ALL SELECT 'voice_speaker_clusters:' || id, trim(label), 'assign', coalesce(person_id::VARCHAR, '') FROM (SELECT DISTINCT ON (id) id, label, person_id FROM voice_speaker_clusters) WHERE person_id IS NOT NULL
UNION ALL SELECT 'meta_face_regions:' || id, trim(name), 'name', coalesce(source, '') FROM (SELECT DISTINCT ON (id) * FROM meta_face_regions) WHERE length(trim(name)) > 0""",
    "region_taxonomy": f"SELECT DISTINCT * FROM ({_REGIONS} UNION ALL SELECT 'People', NULL, trim(preferred_name) FROM people) WHERE leaf <> ''",
    "grown_taxonomy": f"""WITH r AS (SELECT DISTINCT branch AS level, leaf FROM ({_REGIONS}) WHERE leaf <> ''), o AS (SELECT DISTINCT leaf FROM r WHERE level = 'country'), n AS (SELECT DISTINCT leaf FROM r WHERE level <> 'country' AND leaf NOT IN (FROM o))
SELECT 'Regions' AS section, 'all' AS branch, leaf, row_number() OVER (ORDER BY k, leaf) - 1 AS place FROM (SELECT leaf, 0 AS k FROM o UNION ALL SELECT leaf, 1 FROM n)""",
    "tag_tree": "WITH p AS (SELECT string_split(lower(trim(t)), ':') AS p FROM (SELECT unnest(derived_tags) AS t FROM (SELECT DISTINCT ON (file_id) * FROM file_contexts)) WHERE t IS NOT NULL) SELECT DISTINCT p[1] AS top, CASE WHEN len(p) = 3 THEN p[2] END AS middle, p[-1] AS leaf FROM p WHERE len(p) IN (2, 3)",
    "stage_checkpoints": " UNION ALL ".join(f"SELECT '{t}' AS stage, count(DISTINCT file_id) AS n_files, floor(100 * count(DISTINCT file_id) / (SELECT count(DISTINCT id) FROM files)::DOUBLE)::BIGINT AS percent, " + (f"max(epoch_us({STAMPS[t]}))" if t in STAMPS else "NULL::BIGINT") + f" AS last_us FROM {t}" for t in STAGES),
    "latest_ingest": f"SELECT source_id, count(*) AS n_files, arg_max(id, (ingested_at, id)) AS id, arg_max(path, (ingested_at, id)) AS path, epoch_us(max(ingested_at)) AS ingested_us FROM {_F} WHERE source_id IS NOT NULL GROUP BY 1",
    "voice_cluster_list": "SELECT id, label, member_count, person_id, row_number() OVER (ORDER BY member_count DESC NULLS LAST, id) - 1 AS place FROM (SELECT DISTINCT ON (id) id, label, member_count, person_id FROM voice_speaker_clusters)",
    "proposal_list": "SELECT id, location_name, epoch_us(proposed_at) AS proposed_us, row_number() OVER (ORDER BY proposed_at NULLS FIRST, id) - 1 AS place FROM (SELECT DISTINCT ON (id) * FROM gps_proposals) WHERE lower(trim(status)) = 'pending'",
}

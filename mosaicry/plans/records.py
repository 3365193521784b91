"""Queries that bring several tables together: records of files, counts of stages, queues, linked registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.functions.text import path_tokens, stamp_ms, token_class
from mosaicry.operators.facts import resolve_links, same_set_key
from mosaicry.operators.kernels import leaders
from mosaicry.plans.people import TIMED
from mosaicry.tables import load, once

STAGES = ("file_hashes", "file_aesthetic", "gps_proposals", "transcript_segments", "file_voice_segments", "file_voice_embeddings", "file_contexts", "meta_face_regions", "file_gps_cluster_assignments")


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many files each stage has rows for."""
    out = None
    for t in STAGES:
        n = load(spark, d, t).agg(F.countDistinct("file_id").alias("n_files")).select(F.lit(t).alias("stage"), "n_files")
        out = n if out is None else out.unionByName(n)
    return out


def token_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of file names by class and type: how many, in how many files together, and the commonest five."""
    t = once(load(spark, d, "files"), "id").select("id", F.explode(path_tokens(F.col("filename"))).alias("token"))
    n = t.groupBy("token").agg(F.count("*").alias("n")).withColumn("c", token_class(F.col("token")))
    # the five commonest by a bounded merge: each row keeps its own place through a rank over counts, not a gathered list
    from mosaicry.operators.ranking import distributed_rank

    n = distributed_rank(n.select("token", "n", "c.pattern_class", "c.semantic_type").withColumnRenamed("n", "k"), ["pattern_class", "semantic_type"], [F.desc("k"), F.asc("token")])
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") < 5, F.struct("rank", "token")))), lambda x: x["token"]), " ")
    return n.groupBy("pattern_class", "semantic_type").agg(F.count("*").alias("n_tokens"), F.sum("k").alias("n_files"), top.alias("commonest"))


def file_records(spark: SparkSession, d: str) -> DataFrame:
    """One wide record per file: its longest description, whole transcript, tags, terms, date and place.

    Segments without start_ms stand by the timestamp in their text, else last.
    """
    docs = load(spark, d, "documents").filter("file_id IS NOT NULL AND length(text) > 0")
    best = docs.groupBy("file_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("description"))
    seg = once(load(spark, d, "transcript_segments"), "id").filter("length(trim(text)) > 0").withColumn("at", F.coalesce("start_ms", stamp_ms(F.col("text"))))
    line = F.concat(F.coalesce(F.concat(F.trim("speaker_label"), F.lit(": ")), F.lit("")), F.trim("text"))
    lines = seg.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("at").isNull().alias("late"), "at", "id", line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))
    ctx = once(load(spark, d, "file_contexts"), "file_id").select("file_id", F.array_join(F.array_sort(F.array_distinct("derived_tags")), "|").alias("tags"), F.array_join(F.array_sort(F.array_distinct("vocab_terms")), "|").alias("terms"), "metadata_date", "metadata_location")
    f = once(load(spark, d, "files"), "id").select(F.col("id").alias("file_id"), "filename", "file_type")
    return f.join(best, "file_id", "left").join(lines, "file_id", "left").join(ctx, "file_id", "left")


def source_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many contents each two sources have in common."""
    f = load(spark, d, "files").filter("sha256 IS NOT NULL AND source_id IS NOT NULL").select("sha256", "source_id").distinct()
    a, b = f.withColumnRenamed("source_id", "source_a"), f.withColumnRenamed("source_id", "source_b")
    return a.join(b, "sha256").filter("source_a < source_b").groupBy("source_a", "source_b").agg(F.count("*").alias("n"))


def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of tags that several files have alike, whatever their order and case."""
    c = once(load(spark, d, "file_contexts"), "file_id").withColumn("key", same_set_key(F.col("derived_tags"))).filter("key <> ''")
    return c.groupBy("key").agg(F.count("*").alias("n_files")).filter("n_files > 1")


def place_chain(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their regions, found through a register of links of up to three steps."""
    n = load(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    r = load(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    return resolve_links(n.unionByName(r), "key", "parent", "name", 3)


def voice_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Voice segments of each file in the order of time, grouped around running centroids."""
    v = load(spark, d, "file_voice_segments").select("id", "file_id", "start_ms", "embedding")
    return leaders(v, "file_id", "id", "start_ms", "embedding", 0.75).select("id", "file_id", "leader")


QUERIES = {f.__name__: f for f in (stage_counts, token_groups, file_records, source_overlap, tag_sets, place_chain, voice_leaders)}

_TOK = r"""list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(filename, '[/\\.]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[-_\s]+'), lambda x: lower(trim(x))), lambda x: x <> ''))"""

ORACLE = {
    "stage_counts": " UNION ALL ".join(f"SELECT '{t}' AS stage, count(DISTINCT file_id) AS n_files FROM {t}" for t in STAGES),
    "token_groups": rf"""WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM (SELECT DISTINCT ON (id) * FROM files)) GROUP BY 1),
c AS (SELECT *, CASE WHEN regexp_matches(token, '^\d{{8}}$') THEN CASE WHEN token[1:4]::INT BETWEEN 1900 AND 2099 AND token[5:6]::INT BETWEEN 1 AND 12 AND token[7:8]::INT BETWEEN 1 AND 31 THEN '8digit_numeric/date' ELSE '8digit_numeric/unclassified' END
  WHEN regexp_matches(token, '^\d{{6}}$') THEN CASE WHEN token[3:4]::INT BETWEEN 1 AND 12 AND token[5:6]::INT BETWEEN 1 AND 31 THEN '6digit_numeric/date' WHEN token[1:2]::INT <= 23 AND token[3:4]::INT <= 59 THEN '6digit_numeric/time' ELSE '6digit_numeric/unclassified' END
  WHEN regexp_matches(token, '^\d{{3,4}}$') THEN 'sequential/sequential' WHEN regexp_matches(token, '^[a-z0-9]+$') THEN 'word/word' ELSE 'word/unclassified' END AS k FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, token) AS p FROM c)
SELECT split_part(k, '/', 1) AS pattern_class, split_part(k, '/', 2) AS semantic_type, count(*) AS n_tokens, sum(n)::BIGINT AS n_files, string_agg(token, ' ' ORDER BY p) FILTER (p <= 5) AS commonest FROM r GROUP BY k""",
    "file_records": f"""WITH f AS (SELECT DISTINCT ON (id) id AS file_id, filename, file_type FROM files), b AS (SELECT file_id, arg_max(text, (length(text), -doc_id)) AS description FROM documents WHERE file_id IS NOT NULL AND length(text) > 0 GROUP BY 1),
{TIMED}, l AS (SELECT file_id, string_agg(coalesce(trim(speaker_label) || ': ', '') || trim(text), chr(10) ORDER BY at_ms NULLS LAST, id) AS transcript FROM s GROUP BY 1),
c AS (SELECT DISTINCT ON (file_id) file_id, array_to_string(list_sort(list_distinct(derived_tags)), '|') AS tags, array_to_string(list_sort(list_distinct(vocab_terms)), '|') AS terms, metadata_date, metadata_location FROM file_contexts)
SELECT f.*, description, transcript, tags, terms, metadata_date, metadata_location FROM f LEFT JOIN b USING (file_id) LEFT JOIN l USING (file_id) LEFT JOIN c USING (file_id)""",
    "voice_leaders": """WITH RECURSIVE v AS (SELECT DISTINCT ON (id) id, file_id, start_ms, embedding::DOUBLE[] AS e FROM file_voice_segments WHERE embedding IS NOT NULL AND file_id IS NOT NULL),
u AS (SELECT id, file_id, start_ms, list_transform(e, lambda y: y / n) AS x FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS n FROM v) WHERE n > 0),
r AS (SELECT id, file_id, x, row_number() OVER (PARTITION BY file_id ORDER BY start_ms NULLS FIRST, id) AS k FROM u),
s AS (
  SELECT file_id, k, id, id AS leader, [x] AS cs, [1.0::DOUBLE] AS ns, [id] AS ls FROM r WHERE k = 1
  UNION ALL
  SELECT file_id, k, id, CASE WHEN hit THEN ls[b] ELSE id END, CASE WHEN hit THEN list_concat(list_append(cs[:b - 1], list_transform(m, lambda y: y / greatest(sqrt(list_dot_product(m, m)), 1e-12))), cs[b + 1:]) ELSE list_append(cs, x) END,
    CASE WHEN hit THEN list_concat(list_append(ns[:b - 1], ns[b] + 1), ns[b + 1:]) ELSE list_append(ns, 1.0::DOUBLE) END, CASE WHEN hit THEN ls ELSE list_append(ls, id) END
  FROM (SELECT *, list_transform(list_zip(cs[b], x, list_transform(x, lambda y: ns[b])), lambda q: struct_extract(q, 1) * struct_extract(q, 3) + struct_extract(q, 2)) AS m
    FROM (SELECT *, list_position(sims, list_max(sims)) AS b, list_max(sims) >= 0.75 AS hit
      FROM (SELECT r.file_id, r.k, r.id, r.x, cs, ns, ls, list_transform(cs, lambda c: list_dot_product(c, r.x)) AS sims FROM s JOIN r ON r.file_id = s.file_id AND r.k = s.k + 1))))
SELECT id, file_id, leader FROM s""",
    "source_overlap": "WITH f AS (SELECT DISTINCT sha256, source_id FROM files WHERE sha256 IS NOT NULL AND source_id IS NOT NULL) SELECT a.source_id AS source_a, b.source_id AS source_b, count(*) AS n FROM f a JOIN f b ON a.sha256 = b.sha256 AND a.source_id < b.source_id GROUP BY 1, 2",
    "tag_sets": "WITH c AS (SELECT DISTINCT ON (file_id) file_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(derived_tags, lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS key FROM file_contexts) SELECT key, count(*) AS n_files FROM c WHERE key <> '' GROUP BY 1 HAVING count(*) > 1",
    "place_chain": "SELECT 'n' || n_nationkey AS key, n_name AS name, n_name || ' > ' || r_name AS chain FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, r_name FROM region",
}

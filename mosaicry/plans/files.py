"""Queries on files: scope, pending work, names, copies, reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.functions.dates import date_precision, temporal_fields
from mosaicry.functions.text import folder, path_tokens, token_class, token_proposal
from mosaicry.operators.facts import coverage, joined_text, json_facts, pivot_max
from mosaicry.operators.hashes import canonical_ids, greedy_groups
from mosaicry.operators.ranking import band, combined_rank
from mosaicry.operators.rules import apply_rules, standard_rules
from mosaicry.operators.scope import FileScope, having_any, originals, pending
from mosaicry.tables import load, once

MODELS = ["nima_mobilenet", "clip_vit_b32"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return once(load(spark, d, "files"), "id")


def scope_files(spark: SparkSession, d: str) -> DataFrame:
    scope = FileScope(file_type="image", date_from="2005-01-01", date_to="2018-12-31", name_pattern="*harbour*", folder_prefix="/archive/")
    return _files(spark, d).filter(scope.condition()).select("id", "filename")


def pending_hash(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter("sha256 IS NULL").select("id", "path")


def pending_aesthetic(spark: SparkSession, d: str) -> DataFrame:
    """Original images that the first model has not scored."""
    files = originals(_files(spark, d)).filter("file_type = 'image'")
    done = load(spark, d, "file_aesthetic").filter(F.col("model_name") == MODELS[0])
    return pending(files, done).select("id")


def pending_voice(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).filter("file_type IN ('audio', 'video')")
    return pending(files, load(spark, d, "file_voice_embeddings")).select("id")


def pending_summary(spark: SparkSession, d: str) -> DataFrame:
    """Originals with a transcript or a context but without a summary text."""
    texts = load(spark, d, "documents")
    have = having_any(originals(_files(spark, d)), load(spark, d, "transcript_segments").select("file_id"), load(spark, d, "file_contexts").select("file_id"))
    return pending(have, texts.filter("kind = 'summary' AND file_id IS NOT NULL")).select("id")


def folders(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy("source_id", folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"))


def file_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of file names: how often, at which place first, over how many sources, and what is proposed for them."""
    t = _files(spark, d).select("id", "source_id", F.posexplode(path_tokens(F.col("filename"))).alias("pos", "token"))
    g = t.groupBy("token").agg(F.countDistinct("id").alias("n_files"), F.min_by("pos", F.struct("id", "pos")).cast("long").alias("depth"), (F.countDistinct("source_id") > 1).alias("cross_source"))
    c = token_class(F.col("token"))
    p = token_proposal(F.col("c.semantic_type"))
    return g.withColumn("c", c).select("token", "n_files", "depth", "cross_source", "c.pattern_class", "c.semantic_type", p["action"].alias("action"), p["extract_as"].alias("extract_as"))


def token_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring word tokens in at least two files."""
    tokens = F.filter(path_tokens(F.regexp_replace("filename", r"\.[^.]*$", "")), lambda t: token_class(t)["semantic_type"] == "word")
    f = _files(spark, d).select("id", tokens.alias("t")).filter(F.size("t") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))
    g = f.select("id", F.explode(F.array_distinct(pairs)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n_files"))
    return g.filter("n_files >= 2")


def _below_common_folder(spark: SparkSession, d: str) -> DataFrame:
    """(id, source_id, filename, rel): every file with its path below what all paths begin with, as names; the path's root counts as a name until then."""
    part = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda x: ~x.isin("", "."))
    root = F.when(F.col("path").rlike(r"^[/\\]"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    f = _files(spark, d).select("id", "source_id", "filename", F.when(F.length("path") > 0, F.concat(root, part)).alias("names"))
    ends = f.agg(F.min("names").alias("lo"), F.max("names").alias("hi")).first()
    k = len(os.path.commonprefix([ends["lo"] or [], ends["hi"] or []]))
    rest = F.filter(F.slice("names", k + 1, F.greatest(F.size("names"), F.lit(1))), lambda x: x != "/")
    return f.select("id", "source_id", "filename", F.coalesce(rest, F.array().cast("array<string>")).alias("rel"))


def _relative_tokens() -> Column:
    return path_tokens(F.when(F.size("rel") > 0, F.concat_ws("/", "rel")).otherwise(F.col("filename")))


def relative_path_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all files' paths below their common folder: how often, in how many files, folder depth of the first file with it, over how many sources, and what is proposed for them."""
    f = _below_common_folder(spark, d)
    t = f.select("id", "source_id", F.greatest(F.size("rel") - 1, F.lit(0)).cast("long").alias("depth"), F.explode(_relative_tokens()).alias("token"))
    # a token counts once per path, as in the reference, where the tokens of a path are distinct
    g = t.groupBy("token").agg(F.count("*").alias("frequency"), F.countDistinct("id").alias("n_files"), F.min_by("depth", "id").alias("depth"), (F.countDistinct("source_id") > 1).alias("cross_source"))
    c = token_class(F.col("token"))
    p = token_proposal(F.col("c.semantic_type"))
    return g.withColumn("c", c).select("token", "frequency", "n_files", "depth", "cross_source", "c.pattern_class", "c.semantic_type", p["action"].alias("action"), p["extract_as"].alias("extract_as"))


def relative_path_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring tokens of class word in the paths below the common folder, folders and extension included, in at least two files."""
    f = _below_common_folder(spark, d)
    t = f.select("id", F.filter(_relative_tokens(), lambda t: token_class(t)["pattern_class"] == "word").alias("t")).filter(F.size("t") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))
    g = t.select("id", F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("frequency"), F.countDistinct("id").alias("n_files"))
    return g.filter("n_files >= 2")


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_ids(load(spark, d, "files"))


def moved_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For files with an equal content elsewhere: how many others there are, and the first of their paths."""
    f = _files(spark, d).filter("sha256 IS NOT NULL").select("id", "path", "sha256")
    first = f.groupBy("sha256").agg(F.count("*").alias("n"), F.min(F.struct("path", "id")).alias("p"))
    second = f.join(first, "sha256").filter(F.struct("path", "id") > F.col("p")).groupBy("sha256").agg(F.min("path").alias("second"))
    j = f.join(first.filter("n > 1"), "sha256").join(second, "sha256")
    return j.select("id", (F.col("n") - 1).alias("n_others"), F.when(F.col("p.id") == F.col("id"), F.col("second")).otherwise(F.col("p.path")).alias("other_path"))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Files around better scored ones whose fingerprint differs in at most ten bits."""
    h = load(spark, d, "file_hashes").filter("phash <> '0000000000000000'").groupBy("file_id").agg(F.min(F.lower("phash")).alias("phash"))
    s = load(spark, d, "file_aesthetic").filter((F.col("model_name") == MODELS[0]) & F.col("score").between(0, 1)).groupBy("file_id").agg(F.max("score").alias("score"))
    return greedy_groups(h.join(s, "file_id", "left"), "file_id", "phash", "score", 10).withColumnRenamed("id", "file_id")


def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Each file's best valid score by model, where the first model's is at least 0.5."""
    s = load(spark, d, "file_aesthetic").filter(F.col("score").between(0, 1))
    p = pivot_max(s, "file_id", "model_name", "score", MODELS).filter(F.col(MODELS[0]) >= 0.5)
    return p.select("file_id", *MODELS)


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    s = once(load(spark, d, "file_aesthetic"), "id").filter(F.col("score").between(0, 1))
    return s.groupBy("model_name", band(F.col("score"), F.col("model_name")).alias("band")).agg(F.count("*").alias("n"))


def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "file_aesthetic").filter(F.col("score").between(0, 1)).groupBy("file_id", "model_name").agg(F.max("score").alias("score"))
    return combined_rank(s).select("file_id", F.round("score", 9).alias("score"), "band")


def coverage_per_file(spark: SparkSession, d: str) -> DataFrame:
    flags = {"has_hash": load(spark, d, "file_hashes").filter("phash IS NOT NULL"), "has_score": load(spark, d, "file_aesthetic"), "has_gps": load(spark, d, "gps_proposals"), "has_voice": load(spark, d, "file_voice_embeddings"), "has_faces": load(spark, d, "meta_face_regions"), "has_text": load(spark, d, "documents").filter("length(text) > 0")}
    counts = {"n_segments": once(load(spark, d, "transcript_segments").select("id", "file_id"), "id"), "n_voices": once(load(spark, d, "file_voice_segments").select("id", "file_id"), "id")}
    return coverage(_files(spark, d), flags, counts)


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Files by type: how many, how many copies, their size, and the share without a hash."""
    is_copy, no_hash = F.col("canonical_id").isNotNull().cast("int"), F.col("sha256").isNull().cast("int")
    return _files(spark, d).groupBy("file_type").agg(
        F.count("*").alias("n_files"), F.sum(is_copy).alias("n_copies"), F.sum("file_size").alias("bytes"), F.countDistinct("source_id").alias("n_sources"),
        F.round(100 * F.sum(no_hash) / F.count("*"), 1).alias("pct_unhashed"),
    )


def search_text(spark: SparkSession, d: str) -> DataFrame:
    """One searchable line per file: its name, tags and documents, without commas."""
    ctx = once(load(spark, d, "file_contexts"), "file_id")
    tags = joined_text(ctx.select("file_id", F.explode("derived_tags").alias("tag")), "file_id", "tag")
    texts = joined_text(load(spark, d, "documents").filter("file_id IS NOT NULL AND length(text) > 0").select("file_id", "text"), "file_id", "text")
    j = _files(spark, d).select(F.col("id").alias("file_id"), "filename").join(tags, "file_id", "left").join(texts, "file_id", "left")
    return j.select("file_id", F.translate(F.concat_ws(" ", "filename", "tag", "text"), ",", " ").alias("line"))


def temporal(spark: SparkSession, d: str) -> DataFrame:
    """Year to time of day of each file, from its modification time or else from the date in its context."""
    ctx = once(load(spark, d, "file_contexts"), "file_id").select(F.col("file_id").alias("id"), "metadata_date")
    f = _files(spark, d).select("id", F.date_format(F.timestamp_seconds("mtime"), "yyyy:MM:dd HH:mm:ss").alias("taken")).join(ctx, "id", "left")
    return f.withColumn("t", temporal_fields(F.col("taken"), F.col("metadata_date"))).select("id", "t.*")


def date_precisions(spark: SparkSession, d: str) -> DataFrame:
    ctx = once(load(spark, d, "file_contexts"), "file_id")
    return ctx.groupBy(date_precision(F.col("metadata_date")).alias("precision")).agg(F.count("*").alias("n"))


def rule_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all standard rules over what is known of each file."""
    at = F.timestamp_seconds("mtime")
    gps = load(spark, d, "gps_proposals").select(F.col("file_id").alias("id")).distinct().withColumn("g", F.lit("true"))
    f = _files(spark, d).join(gps, "id", "left")
    entries = [("file_date", F.date_format(at, "yyyy-MM-dd")), ("hour_of_day", F.hour(at).cast("string")), ("file_format", F.col("ext")), ("gps_present", F.col("g"))]
    f = f.select("id", F.create_map(*[x for k, v in entries for x in (F.lit(k), v)]).alias("fields"))
    return apply_rules(f, "id", "fields", standard_rules())


def event_facts(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the JSON documents in events: how often each name occurs, and its range of numbers."""
    e = json_facts(load(spark, d, "events"), "event_id", "props")
    v = F.col("value").try_cast("double")
    return e.groupBy("name").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def new_terms(spark: SparkSession, d: str) -> DataFrame:
    """Tags that are in no vocabulary list, by the number of times they were given."""
    ctx = once(load(spark, d, "file_contexts"), "file_id")
    term = lambda c: F.lower(F.trim(c))
    vocab = ctx.select(F.explode("vocab_terms").alias("t")).select(term("t").alias("term")).distinct()
    tags = ctx.select(F.explode("derived_tags").alias("t")).select(term("t").alias("term")).filter("term <> ''")
    return tags.groupBy("term").agg(F.count("*").alias("n")).join(vocab, "term", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        scope_files, pending_hash, pending_aesthetic, pending_voice, pending_summary, folders, file_tokens, token_bigrams, relative_path_tokens, relative_path_bigrams, canonical, moved_candidates, near_duplicates, score_pivot,
        score_bands, combined_scores, coverage_per_file, corpus_stats, search_text, temporal, date_precisions, rule_tags, event_facts, new_terms,
    )
}

_F = "SELECT DISTINCT ON (id) * FROM files"
_TOK = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({c}, '[/\\.]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[-_\s]+'), lambda x: lower(trim(x))), lambda x: x <> '')"""
_REL = rf"""f AS (SELECT id, source_id, filename, CASE WHEN path <> '' THEN list_concat(CASE WHEN replace(path, '\', '/') LIKE '/%' THEN ['/'] ELSE [] END, list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.'))) END AS c FROM ({_F})),
m AS (SELECT min(c) AS lo, max(c) AS hi FROM f), k AS (SELECT coalesce(list_min(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(len(lo), len(hi))) AS k FROM m),
r AS (SELECT id, source_id, filename, coalesce(list_filter(c[k + 1:], lambda x: x <> '/'), []) AS c FROM f, k),
w AS (SELECT id, source_id, greatest(len(c) - 1, 0) AS depth, {_TOK.format(c="CASE WHEN len(c) > 0 THEN array_to_string(c, '/') ELSE filename END")} AS t FROM r),
x AS (SELECT id, source_id, depth, unnest(t) AS token, unnest(range(len(t))) AS p FROM w), u AS (SELECT id, source_id, depth, token, min(p) AS p FROM x GROUP BY 1, 2, 3, 4),
c AS (SELECT *, CASE WHEN regexp_matches(token, '^\d{{8}}$') THEN CASE WHEN token[1:4]::INT BETWEEN 1900 AND 2099 AND token[5:6]::INT BETWEEN 1 AND 12 AND token[7:8]::INT BETWEEN 1 AND 31 THEN '8digit_numeric/date' ELSE '8digit_numeric/unclassified' END
  WHEN regexp_matches(token, '^\d{{6}}$') THEN CASE WHEN token[3:4]::INT BETWEEN 1 AND 12 AND token[5:6]::INT BETWEEN 1 AND 31 THEN '6digit_numeric/date' WHEN token[1:2]::INT <= 23 AND token[3:4]::INT <= 59 THEN '6digit_numeric/time' ELSE '6digit_numeric/unclassified' END
  WHEN regexp_matches(token, '^\d{{3,4}}$') THEN 'sequential/sequential' WHEN regexp_matches(token, '^[a-z0-9]+$') THEN 'word/word' ELSE 'word/unclassified' END AS k FROM u)"""
_MD = "(month({a}) = {m} AND day({a}) = {d})"
_EASTER = """(SELECT make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
  SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM (SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM (
  SELECT y, y % 19 AS a, y // 100 AS b, (y // 100) // 4 AS d, (y // 100) % 4 AS e, (y // 100 - (y // 100 + 8) // 25 + 1) // 3 AS g, (y % 100) // 4 AS i, (y % 100) % 4 AS k FROM (SELECT year({a}) AS y))))))"""
_NTH = "(month({a}) = {m} AND isodow({a}) = {w} AND day({a}) BETWEEN {lo} AND {hi})"
_FEASTS = [("Christmas Day", 12, 25), ("Christmas Eve", 12, 24), ("Boxing Day", 12, 26), ("New Year''s Day", 1, 1), ("New Year''s Eve", 12, 31), ("Valentine''s Day", 2, 14), ("St. Patrick''s Day", 3, 17), ("ANZAC Day", 4, 25), ("Halloween", 10, 31), ("Canada Day", 7, 1), ("Remembrance Day", 11, 11)]
_MOVING = [("Canadian Thanksgiving", 10, 1, 8, 14), ("US Thanksgiving", 11, 4, 22, 28), ("Mother''s Day", 5, 7, 8, 14), ("Father''s Day", 6, 7, 15, 21)]


def _holidays(a: str) -> list[tuple[str, str]]:
    out = [(n, _MD.format(a=a, m=m, d=x)) for n, m, x in _FEASTS] + [("Easter", f"{a} = {_EASTER.format(a=a)}")]
    return out + [(n, _NTH.format(a=a, m=m, w=w, lo=lo, hi=hi)) for n, m, w, lo, hi in _MOVING]


_SEASON = "CASE WHEN month({a}) IN (3, 4, 5) THEN 'Spring' WHEN month({a}) IN (6, 7, 8) THEN 'Summer' WHEN month({a}) IN (9, 10, 11) THEN 'Autumn' WHEN month({a}) IN (12, 1, 2) THEN 'Winter' END"
_BAND = "CASE WHEN {h} <= 4 THEN 'overnight' WHEN {h} = 5 THEN 'blue_hour_morning' WHEN {h} <= 7 THEN 'golden_hour_morning' WHEN {h} <= 10 THEN 'morning' WHEN {h} <= 13 THEN 'midday' WHEN {h} <= 16 THEN 'afternoon' WHEN {h} <= 18 THEN 'golden_hour_evening' WHEN {h} = 19 THEN 'blue_hour_evening' WHEN {h} <= 23 THEN 'night' END"
_SCORES = "(SELECT file_id, model_name, max(score) AS score FROM file_aesthetic WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2)"

ORACLE = {
    "scope_files": f"SELECT id, filename FROM ({_F}) WHERE file_type = 'image' AND lower(path) LIKE '/archive/%' AND filename ILIKE '%harbour%' AND CAST(to_timestamp(mtime) AS DATE) BETWEEN DATE '2005-01-01' AND DATE '2018-12-31'",
    "pending_hash": f"SELECT id, path FROM ({_F}) WHERE sha256 IS NULL",
    "pending_aesthetic": f"SELECT id FROM ({_F}) f WHERE file_type = 'image' AND canonical_id IS NULL AND NOT EXISTS (SELECT 1 FROM file_aesthetic a WHERE a.file_id = f.id AND model_name = 'nima_mobilenet')",
    "pending_voice": f"SELECT id FROM ({_F}) f WHERE file_type IN ('audio', 'video') AND NOT EXISTS (SELECT 1 FROM file_voice_embeddings a WHERE a.file_id = f.id)",
    "pending_summary": f"SELECT id FROM ({_F}) f WHERE canonical_id IS NULL AND (EXISTS (SELECT 1 FROM transcript_segments t WHERE t.file_id = f.id) OR EXISTS (SELECT 1 FROM file_contexts c WHERE c.file_id = f.id)) AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.file_id = f.id AND kind = 'summary')",
    "folders": rf"SELECT source_id, regexp_replace(replace(path, '\', '/'), '/[^/]*$', '') AS folder, count(*) AS n_files FROM ({_F}) GROUP BY 1, 2",
    "file_tokens": rf"""WITH w AS (SELECT id, source_id, {_TOK.format(c="filename")} AS t FROM ({_F})),
x AS (SELECT id, source_id, unnest(t) AS token, unnest(range(len(t))) AS p FROM w),
u AS (SELECT id, source_id, token, row_number() OVER (PARTITION BY id ORDER BY min(p)) - 1 AS pos FROM x GROUP BY 1, 2, 3),
g AS (SELECT token, count(*) AS n_files, arg_min(pos, (id, pos)) AS depth, count(DISTINCT source_id) > 1 AS cross_source FROM u GROUP BY token),
c AS (SELECT *, CASE WHEN regexp_matches(token, '^\d{{8}}$') THEN CASE WHEN token[1:4]::INT BETWEEN 1900 AND 2099 AND token[5:6]::INT BETWEEN 1 AND 12 AND token[7:8]::INT BETWEEN 1 AND 31 THEN '8digit_numeric/date' ELSE '8digit_numeric/unclassified' END
  WHEN regexp_matches(token, '^\d{{6}}$') THEN CASE WHEN token[3:4]::INT BETWEEN 1 AND 12 AND token[5:6]::INT BETWEEN 1 AND 31 THEN '6digit_numeric/date' WHEN token[1:2]::INT <= 23 AND token[3:4]::INT <= 59 THEN '6digit_numeric/time' ELSE '6digit_numeric/unclassified' END
  WHEN regexp_matches(token, '^\d{{3,4}}$') THEN 'sequential/sequential' WHEN regexp_matches(token, '^[a-z0-9]+$') THEN 'word/word' ELSE 'word/unclassified' END AS k FROM g),
s AS (SELECT *, split_part(k, '/', 1) AS pattern_class, split_part(k, '/', 2) AS semantic_type FROM c)
SELECT token, n_files, depth, cross_source, pattern_class, semantic_type, CASE WHEN semantic_type IN ('date', 'time', 'code') THEN 'capture' WHEN semantic_type = 'sequential' THEN 'ignore' ELSE 'none' END AS action,
  CASE semantic_type WHEN 'date' THEN 'file_date' WHEN 'time' THEN 'file_time' WHEN 'code' THEN 'route_number' ELSE '' END AS extract_as FROM s""",
    "token_bigrams": rf"""WITH w AS (SELECT id, {_TOK.format(c="regexp_replace(filename, '[.][^.]*$', '')")} AS t FROM ({_F})),
x AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS p FROM w), u AS (SELECT id, token, min(p) AS p FROM x GROUP BY 1, 2),
k AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY p) AS p FROM u WHERE regexp_matches(token, '^[a-z0-9]+$') AND NOT regexp_matches(token, '^(\d{{8}}|\d{{6}}|\d{{3,4}})$'))
SELECT a.token || ' ' || b.token AS bigram, count(DISTINCT a.id) AS n_files FROM k a JOIN k b ON a.id = b.id AND b.p = a.p + 1 GROUP BY 1 HAVING count(DISTINCT a.id) >= 2""",
    "relative_path_tokens": f"""WITH {_REL},
s AS (SELECT token, count(*) AS frequency, count(DISTINCT id) AS n_files, arg_min(depth, id) AS depth, count(DISTINCT source_id) > 1 AS cross_source, any_value(split_part(k, '/', 1)) AS pattern_class, any_value(split_part(k, '/', 2)) AS semantic_type FROM c GROUP BY token)
SELECT *, CASE WHEN semantic_type IN ('date', 'time', 'code') THEN 'capture' WHEN semantic_type = 'sequential' THEN 'ignore' ELSE 'none' END AS action,
  CASE semantic_type WHEN 'date' THEN 'file_date' WHEN 'time' THEN 'file_time' WHEN 'code' THEN 'route_number' ELSE '' END AS extract_as FROM s""",
    "relative_path_bigrams": f"""WITH {_REL}, o AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY p) AS p FROM c WHERE k LIKE 'word/%')
SELECT a.token || ' ' || b.token AS bigram, count(*) AS frequency, count(DISTINCT a.id) AS n_files FROM o a JOIN o b ON a.id = b.id AND b.p = a.p + 1 GROUP BY 1 HAVING count(DISTINCT a.id) >= 2""",
    "canonical": f"SELECT id, m AS canonical_id FROM (SELECT id, min(id) OVER (PARTITION BY sha256) AS m FROM ({_F}) WHERE sha256 IS NOT NULL) WHERE id <> m",
    "moved_candidates": f"WITH f AS (SELECT id, path, sha256 FROM ({_F}) WHERE sha256 IS NOT NULL) SELECT a.id, count(*) AS n_others, arg_min(b.path, (b.path, b.id)) AS other_path FROM f a JOIN f b ON a.sha256 = b.sha256 AND a.id <> b.id GROUP BY a.id",
    "near_duplicates": """WITH RECURSIVE h AS (SELECT file_id, min(lower(phash)) AS p FROM file_hashes WHERE phash <> '0000000000000000' GROUP BY 1), s AS (SELECT file_id, max(score) AS score FROM file_aesthetic WHERE model_name = 'nima_mobilenet' AND score BETWEEN 0 AND 1 GROUP BY 1),
r AS (SELECT file_id, score, ('0x' || trim(p))::UBIGINT AS b, row_number() OVER (ORDER BY score IS NULL, score DESC, file_id) AS k FROM h LEFT JOIN s USING (file_id) WHERE regexp_matches(trim(p), '^[0-9a-f]{16}$')),
z AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS seeds UNION ALL SELECT r.k, CASE WHEN coalesce(list_bool_or(list_transform(seeds, lambda x: bit_count(xor(x, r.b)) <= 10)), false) THEN seeds ELSE list_append(seeds, r.b) END FROM z JOIN r ON r.k = z.k + 1),
l AS (SELECT arg_max(seeds, k) AS seeds FROM z), d AS (SELECT unnest(seeds) AS b, unnest(range(len(seeds))) AS i FROM l), o AS (SELECT b, arg_min(file_id, k) AS seed_id FROM r GROUP BY 1),
a AS (SELECT r.file_id, r.score, r.b, arg_min(d.b, i) AS sb FROM r JOIN d ON bit_count(xor(r.b, d.b)) <= 10 GROUP BY 1, 2, 3), g AS (SELECT file_id, score, seed_id, bit_count(xor(a.b, sb))::INT AS distance, count(*) OVER (PARTITION BY seed_id) AS n FROM a JOIN o ON o.b = sb)
SELECT file_id, seed_id, distance, row_number() OVER (PARTITION BY seed_id ORDER BY score IS NULL, score DESC, file_id) AS place FROM g WHERE n > 1""",
    "score_pivot": f"SELECT file_id, max(score) FILTER (model_name = 'nima_mobilenet') AS nima_mobilenet, max(score) FILTER (model_name = 'clip_vit_b32') AS clip_vit_b32 FROM {_SCORES} GROUP BY file_id HAVING max(score) FILTER (model_name = 'nima_mobilenet') >= 0.5",
    "score_bands": """SELECT model_name, CASE model_name WHEN 'nima_mobilenet' THEN CASE WHEN score >= 0.75 THEN 'excellent' WHEN score >= 0.55 THEN 'good' WHEN score >= 0.3 THEN 'average' ELSE 'poor' END
  WHEN 'clip_vit_b32' THEN CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.62 THEN 'good' WHEN score >= 0.3 THEN 'average' ELSE 'poor' END
  ELSE CASE WHEN score >= 0.75 THEN 'excellent' WHEN score >= 0.5 THEN 'good' WHEN score >= 0.25 THEN 'average' ELSE 'poor' END END AS band, count(*) AS n
  FROM (SELECT DISTINCT ON (id) * FROM file_aesthetic) WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2""",
    "combined_scores": f"""WITH s AS (SELECT *, (row_number() OVER (PARTITION BY model_name ORDER BY score, file_id) - 1)::DOUBLE AS r, count(*) OVER (PARTITION BY model_name) AS n FROM {_SCORES} WHERE model_name IS NOT NULL AND file_id IS NOT NULL),
m AS (SELECT count(DISTINCT model_name) AS k FROM s), a AS (SELECT file_id, avg(CASE WHEN n > 1 THEN r / (n - 1) ELSE 0.5 END) AS score, count(*) AS c FROM s GROUP BY file_id)
SELECT file_id, round(score, 9) AS score, CASE WHEN score >= 0.75 THEN 'excellent' WHEN score >= 0.5 THEN 'good' WHEN score >= 0.25 THEN 'average' ELSE 'poor' END AS band FROM a, m WHERE c = k AND k > 1""",
    "coverage_per_file": f"""SELECT id, path, id IN (SELECT file_id FROM file_hashes WHERE phash IS NOT NULL) AS has_hash, id IN (SELECT file_id FROM file_aesthetic WHERE file_id IS NOT NULL) AS has_score, id IN (SELECT file_id FROM gps_proposals WHERE file_id IS NOT NULL) AS has_gps,
 id IN (SELECT file_id FROM file_voice_embeddings) AS has_voice, id IN (SELECT file_id FROM meta_face_regions WHERE file_id IS NOT NULL) AS has_faces, id IN (SELECT file_id FROM documents WHERE length(text) > 0 AND file_id IS NOT NULL) AS has_text,
 coalesce(s.n, 0) AS n_segments, coalesce(v.n, 0) AS n_voices FROM ({_F}) f LEFT JOIN (SELECT file_id, count(DISTINCT id) AS n FROM transcript_segments GROUP BY 1) s ON s.file_id = f.id LEFT JOIN (SELECT file_id, count(DISTINCT id) AS n FROM file_voice_segments GROUP BY 1) v ON v.file_id = f.id""",
    "corpus_stats": f"SELECT file_type, count(*) AS n_files, count(canonical_id) AS n_copies, sum(file_size)::BIGINT AS bytes, count(DISTINCT source_id) AS n_sources, round(100 * count(*) FILTER (sha256 IS NULL) / count(*)::DOUBLE, 1) AS pct_unhashed FROM ({_F}) GROUP BY 1",
    "search_text": f"""WITH c AS (SELECT DISTINCT ON (file_id) * FROM file_contexts), t AS (SELECT file_id, string_agg(tag, ' ' ORDER BY tag) AS tag FROM (SELECT DISTINCT file_id, unnest(derived_tags) AS tag FROM c) WHERE tag IS NOT NULL GROUP BY 1),
x AS (SELECT file_id, string_agg(text, ' ' ORDER BY text) AS text FROM (SELECT DISTINCT file_id, text FROM documents WHERE file_id IS NOT NULL AND length(text) > 0) GROUP BY 1)
SELECT id AS file_id, replace(concat_ws(' ', filename, tag, text), ',', ' ') AS line FROM ({_F}) f LEFT JOIN t ON t.file_id = f.id LEFT JOIN x ON x.file_id = f.id""",
    "temporal": f"""WITH c AS (SELECT DISTINCT ON (file_id) file_id, metadata_date FROM file_contexts),
f AS (SELECT id, date_trunc('second', to_timestamp(mtime))::TIMESTAMP AS ts, CASE WHEN regexp_matches(trim(metadata_date), '^\\d{{4}}[-:]\\d\\d[-:]\\d\\d') THEN TRY_CAST(replace(substr(trim(metadata_date), 1, 10), ':', '-') AS DATE) END AS md FROM ({_F}) x LEFT JOIN c ON c.file_id = x.id),
g AS (SELECT id, coalesce(ts::DATE, md) AS a, hour(ts) AS h FROM f)
SELECT id, year(a)::INT AS year, (year(a) // 10 * 10) || 's' AS decade, monthname(a) AS month_name, {_SEASON.format(a="a")} AS season, dayname(a) AS day_name, CASE {" ".join(f"WHEN {c} THEN '{n}'" for n, c in _holidays("a"))} END AS holiday, {_BAND.format(h="h")} AS time_of_day FROM g""",
    "date_precisions": r"""SELECT CASE WHEN metadata_date IS NULL OR metadata_date = '' THEN 'full' WHEN regexp_matches(trim(metadata_date), '^\d{4}$') THEN 'year' WHEN regexp_matches(trim(metadata_date), '^\d{4}s$') THEN 'decade'
 WHEN len(string_split(trim(metadata_date), '-')) >= 3 THEN 'full' WHEN len(string_split(trim(metadata_date), '-')) = 2 THEN 'month' ELSE 'year' END AS precision, count(*) AS n FROM (SELECT DISTINCT ON (file_id) * FROM file_contexts) GROUP BY 1""",
    "rule_tags": f"""WITH f AS (SELECT id, to_timestamp(mtime)::TIMESTAMP AS ts, to_timestamp(mtime)::DATE AS a, lower(ext) AS e, id IN (SELECT file_id FROM gps_proposals WHERE file_id IS NOT NULL) AS g FROM ({_F}))
SELECT id, {_SEASON.format(a="a")} AS tag, 'calendar' AS category FROM f WHERE a IS NOT NULL
UNION ALL SELECT id, (year(a) // 10 * 10) || 's', 'calendar' FROM f WHERE a IS NOT NULL
UNION ALL SELECT id, {_BAND.format(h="hour(ts)")}, 'temporal' FROM f WHERE a IS NOT NULL
{"".join(f"UNION ALL SELECT id, '{n}', 'calendar' FROM f WHERE {c} " for n, c in _holidays("a"))}
UNION ALL SELECT id, 'raw_file', 'technical' FROM f WHERE e IN ('raw', 'arw', 'cr2', 'cr3', 'nef', 'orf', 'raf', 'rw2', 'dng', 'pef', 'srw')
UNION ALL SELECT id, 'heic', 'technical' FROM f WHERE e IN ('heic', 'heif') UNION ALL SELECT id, 'tiff', 'technical' FROM f WHERE e IN ('tif', 'tiff')
UNION ALL SELECT id, 'video', 'technical' FROM f WHERE e IN ('mp4', 'mov', 'avi', 'mkv', 'm4v', 'mts', 'm2ts', 'wmv', 'flv', 'webm', '3gp')
UNION ALL SELECT id, 'geotagged', 'technical' FROM f WHERE g""",
    "event_facts": "WITH e AS (SELECT unnest(json_keys(props)) AS name, props FROM events WHERE json_valid(props)), v AS (SELECT name, json_extract_string(props, '$.' || name) AS v FROM e) SELECT name, count(*) AS n, min(TRY_CAST(v AS DOUBLE)) AS least, max(TRY_CAST(v AS DOUBLE)) AS greatest FROM v WHERE v IS NOT NULL GROUP BY name",
    "new_terms": "WITH c AS (SELECT DISTINCT ON (file_id) * FROM file_contexts), v AS (SELECT DISTINCT lower(trim(t)) AS term FROM (SELECT unnest(vocab_terms) AS t FROM c) WHERE t IS NOT NULL) SELECT lower(trim(t)) AS term, count(*) AS n FROM (SELECT unnest(derived_tags) AS t FROM c) WHERE trim(t) <> '' AND lower(trim(t)) NOT IN (SELECT term FROM v) GROUP BY 1",
}

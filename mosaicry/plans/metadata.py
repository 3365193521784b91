"""Queries on metadata documents of files, rules over camera data, lives of people, keywords and spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.functions.text import normal_name, path_tokens
from mosaicry.operators import metadata as m
from mosaicry.operators.rules import RANGES, apply_rules, normalised_name, standard_rules
from mosaicry.plans.exports import export_people_events
from mosaicry.plans.files import combined_scores
from mosaicry.tables import load, once

FIELD_MAP = [
    {"canonical": "taken", "tag": "EXIF:DateTimeOriginal", "priority": 1, "type": "date"}, {"canonical": "taken", "tag": "XMP:CreateDate", "priority": 2, "type": "date"},
    {"canonical": "place", "tag": "XMP:Location", "priority": 1, "type": "str"}, {"canonical": "size", "tag": "File:FileSize", "priority": 1, "type": "int"},
    {"canonical": "keywords", "tag": "IPTC:Keywords", "priority": 1, "type": "keyword_list"}, {"canonical": "terms", "tag": "XMP:Subject", "priority": 1, "type": "keyword_list"},
]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, meta): what is known of each file as one JSON document, absent fields left out."""
    c = once(load(spark, d, "file_contexts"), "file_id").select(F.col("file_id").alias("id"), "derived_tags", "vocab_terms", "metadata_date", "metadata_location")
    f = once(load(spark, d, "files"), "id").select("id", "file_size", "mtime").join(c, "id", "left")
    fields = [
        F.date_format(F.timestamp_seconds("mtime"), "yyyy:MM:dd HH:mm:ss").alias("EXIF:DateTimeOriginal"), F.col("metadata_date").alias("XMP:CreateDate"), F.col("metadata_location").alias("XMP:Location"),
        F.col("file_size").alias("File:FileSize"), F.col("derived_tags").alias("IPTC:Keywords"), F.col("vocab_terms").alias("XMP:Subject"),
    ]
    return f.select(F.col("id").alias("file_id"), F.to_json(F.struct(*fields)).alias("meta"))


def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    """Canonical fields of each file's metadata document."""
    return m.extracted_fields(_documents(spark, d), "file_id", "meta", FIELD_MAP)


def metadata_keywords(spark: SparkSession, d: str) -> DataFrame:
    return m.extracted_keywords(_documents(spark, d), "file_id", "meta", FIELD_MAP)


def unmapped_fields(spark: SparkSession, d: str) -> DataFrame:
    """Known tags that occur in documents but are in no field map that holds dates only."""
    return m.unmapped_tags(_documents(spark, d), "meta", [r["tag"] for r in FIELD_MAP], ["EXIF:DateTimeOriginal", "XMP:CreateDate"])


def metadata_faces(spark: SparkSession, d: str) -> DataFrame:
    """Face regions read back from documents of parallel arrays, one for each file and source."""
    r = once(load(spark, d, "meta_face_regions"), "id").filter("file_id IS NOT NULL")
    b = F.col("bbox_norm")
    g = r.groupBy("file_id", "source").agg(F.sort_array(F.collect_list(F.struct("id", "name", *[b[i].alias(c) for i, c in enumerate("XYWH")]))).alias("r"))
    of = lambda c: F.transform("r", lambda x: x[c])
    known = lambda c: F.transform("r", lambda x: F.coalesce(x[c].cast("string"), F.lit("?")))  # noqa: E731 - nulls inside arrays would be lost
    kinds = F.transform("r", lambda x: F.lit("Face"))
    names = F.transform("r", lambda x: F.coalesce(x["name"], F.lit("")))
    one = F.to_json(F.struct(names.alias("RegionName"), kinds.alias("RegionType"), *[known(c).alias(f"RegionArea{c}") for c in "XYWH"]))
    two = F.to_json(F.struct(names.alias("ACDSeeRegionName"), *[known(c).alias(f"ACDSeeRegionALGArea{c}") for c in "XYWH"]))
    docs = g.select(F.struct("file_id", F.size(of("id")).alias("n")).alias("k"), F.when(F.col("source") == "mwg-rs", one).otherwise(two).alias("doc"))
    return m.face_regions(docs, "k", "doc", m.REGION_TAGS).select("k.file_id", "source", "place", "name", "cx", "cy", "w", "h")


def _double(a: str, b: int) -> str:
    return f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)"


#: Camera data made of the numbers of parts, the same expressions in both dialects.
CAMERA = {
    "exif_width": "p_retailprice * 3", "exif_height": "CAST(p_size * 100 AS DOUBLE)", "focal_length_35mm": "CAST(p_size * 5 AS DOUBLE)", "aperture": _double("p_size", 4), "shutter_speed": _double("p_size", 40),
    "iso": "CAST(p_partkey % 80 * 50 AS DOUBLE)", "flash": "CAST(p_partkey % 4 AS DOUBLE)",
}
QUALITY = {"exposure": _double("p_partkey % 100", 100), "highlights": _double("p_partkey % 37", 37), "shadows": _double("p_partkey % 23", 23), "luminance_std_dev": _double("p_partkey % 29", 100), "saturation_mean": _double("p_partkey % 61", 61), "dominant_hue": "CAST(p_partkey % 360 AS DOUBLE)"}


def camera_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all standard rules over camera data and picture measures."""
    # a small file holds many rows of long work: one partition per file would leave most cores idle
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    p = p.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "p_partkey")
    captured = F.create_map(*[x for k, v in CAMERA.items() for x in (F.lit(k), F.expr(v).cast("string"))])
    metadata = F.create_map(F.lit("iso"), F.lit("0"), F.lit("exif_date_taken"), F.concat(F.lit("2021-03-04T"), F.lpad((F.col("p_partkey") % 24).cast("string"), 2, "0"), F.lit(":10:00")))
    f = p.select(F.col("p_partkey").alias("id"), m.rule_fields(captured, metadata, F.lit(""), {k: F.expr(v) for k, v in QUALITY.items()}).alias("fields"))
    return apply_rules(f, "id", "fields", standard_rules())


def life_event_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of files in which a registered person is named, on the days of that person's events."""
    tidy = lambda c: F.lower(F.trim(c))
    people = once(load(spark, d, "people").select("id", "preferred_name"), "id").filter("length(trim(preferred_name)) > 0").groupBy(tidy("preferred_name").alias("who")).agg(F.min("id").alias("id"))
    kind = F.when(F.col("event") == "registered", "birth").when(F.col("event") == "first heard", "marriage").otherwise("death")
    events = export_people_events(spark, d).select("id", F.trim("preferred_name").alias("name"), kind.alias("event"), "date")
    named = once(load(spark, d, "meta_face_regions"), "id").select("file_id", tidy("name").alias("who")).distinct().join(people, "who").join(events, "id")
    f = once(load(spark, d, "files"), "id").select(F.col("id").alias("file_id"), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd").alias("day"))
    return named.join(f, "file_id").select("file_id", m.life_event_tag(F.col("day"), F.col("name"), F.col("event"), F.col("date")).alias("tag")).filter("tag IS NOT NULL").distinct()


def _tags(spark: SparkSession, d: str) -> DataFrame:
    c = once(load(spark, d, "file_contexts"), "file_id")
    return c.select("file_id", F.explode("derived_tags").alias("tag")).filter("trim(tag) <> ''")


def tag_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Tags that differ in case and blanks only."""
    return m.spelling_groups(_tags(spark, d), "tag", F.lower(F.trim("tag"))).withColumn("terms", F.array_join("terms", "|"))


def place_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Names of places that are one after case, punctuation and blanks."""
    g = once(load(spark, d, "gps_proposals"), "id").select(F.trim("location_name").alias("name"))
    return m.spelling_groups(g, "name", normal_name(F.col("name"))).withColumn("terms", F.array_join("terms", "|"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Each spelled tag with its other spellings as synonyms; those of colon tags are always written, those of one word never."""
    g = m.spelling_groups(_tags(spark, d), "tag", F.lower(F.trim("tag"))).select("terms", F.explode("terms").alias("term"))
    policy = F.when(F.col("term").contains(":"), True).when(~F.trim("term").contains(" "), False)
    return g.select("term", F.array_except("terms", F.array("term")).alias("synonyms"), policy.alias("write_synonyms"))


def written_keywords(spark: SparkSession, d: str) -> DataFrame:
    """What would be written to each file: its tags and their synonyms."""
    return m.resolved_keywords(_tags(spark, d), "file_id", "tag", _vocabulary(spark, d), True)


def tag_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return m.synonym_map(_vocabulary(spark, d))


def taken_up_terms(spark: SparkSession, d: str) -> DataFrame:
    """Files for which the tag ``weekend`` was proposed as a term or tag of another spelling, with their tags as they become."""
    c = once(load(spark, d, "file_contexts"), "file_id")
    proposed = F.transform(F.concat(F.coalesce("derived_tags", F.array().cast("array<string>")), F.coalesce("vocab_terms", F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)))
    return c.select("file_id", m.with_term(F.col("derived_tags"), proposed, "weekend").alias("t")).filter("t IS NOT NULL").select("file_id", F.array_join("t", "|").alias("tags"))


NAME_RULES = [
    {"pattern": r"\d{5}$", "is_regex": True, "action": "capture", "extract_as": "sequence", "keep_token": False},
    {"pattern": "copy", "is_regex": False, "action": "reject"}, {"pattern": "edit", "is_regex": False, "action": "ignore"},
    {"pattern": "vid", "is_regex": False, "action": "replace", "replace_with": "video"}, {"pattern": "dsc", "is_regex": False, "action": "replace", "replace_with": "picture"},
]


def normalised_files(spark: SparkSession, d: str) -> DataFrame:
    """Names of files after the rules for tokens, and the numbers these captured."""
    f = once(load(spark, d, "files"), "id").select("id", normalised_name(F.col("filename"), NAME_RULES, ["page"], ["roll"], [("album", "book")]).alias("n"))
    return f.select("id", "n.name", F.try_element_at("n.captured", F.lit("sequence")).alias("sequence"))


def open_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of file names that no rule decides and nobody rejected, with their number of files."""
    t = once(load(spark, d, "files"), "id").select("id", F.explode(path_tokens(F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""))).alias("token"))
    decided = F.col("token").isin("roll")
    for r in NAME_RULES:
        decided = decided | (F.col("token").rlike("^(?:" + r["pattern"] + ")") if r["is_regex"] else F.col("token") == r["pattern"])
    return t.filter(~decided).groupBy("token").agg(F.count("*").alias("n_files"))


TEXT_RULES = [(r"\s+", " "), (r"([0-9]+) ?m([ .,;])", r"\1 metres\2"), (r"^ | $", ""), (r"(harbour) (survey)", r"\2 of the \1")]


def normal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents after rules of substitution in order."""
    return load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", m.substituted(F.col("text"), TEXT_RULES).alias("text"))


def open_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of files that no pattern rules out, with their number of files."""
    c = once(load(spark, d, "file_contexts"), "file_id").select("file_id", F.explode("vocab_terms").alias("t")).select("file_id", F.trim("t").alias("term")).filter("term <> ''").distinct()
    return c.filter(~m.matches_any(F.col("term"), [(r"^early ", True), (r"(barn|quay)$", True), ("quiet depot", False)])).groupBy("term").agg(F.count("*").alias("n_files"))


def file_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model would be asked about each file."""
    c = once(load(spark, d, "file_contexts"), "file_id")
    lines = {"Date": F.col("metadata_date"), "Place": F.col("metadata_location"), "Tags": F.array_join("derived_tags", ", "), "Terms": F.array_join("vocab_terms", ", ")}
    return c.select("file_id", m.prompt({k: F.coalesce(v, F.lit("")) for k, v in lines.items()}, "Describe what this file shows.", "people and places").alias("prompt"))


def enrichment_texts(spark: SparkSession, d: str) -> DataFrame:
    """The words of each file's fields that are no numbers, then its keywords in order."""
    docs = _documents(spark, d)
    numeric = [r["canonical"] for r in FIELD_MAP if r["type"] in ("int", "float")]
    f = m.extracted_fields(docs, "file_id", "meta", FIELD_MAP).filter(~F.col("canonical").isin(*numeric)).select("file_id", F.lit(0).alias("k"), F.col("canonical").alias("o"), F.col("value").alias("v"))
    k = m.extracted_keywords(docs, "file_id", "meta", FIELD_MAP).select("file_id", F.lit(1).alias("k"), F.col("keyword").alias("o"), F.col("keyword").alias("v")).distinct()
    g = f.unionByName(k).filter("v <> ''").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("k", "o", "v"))).alias("p"))
    return g.select("file_id", F.array_join(F.transform("p", lambda x: x["v"]), " ").alias("text"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """One to five stars for files that all models scored."""
    return combined_scores(spark, d).select("file_id", F.greatest(F.lit(1), F.ceil(F.col("score") * 5)).cast("int").alias("stars"))


QUERIES = {
    f.__name__: f
    for f in (
        metadata_fields, metadata_keywords, unmapped_fields, metadata_faces, camera_tags, life_event_tags, tag_spellings, place_spellings, written_keywords, tag_synonyms, taken_up_terms, normalised_files, open_tokens,
        normal_texts, open_terms, file_prompts, enrichment_texts, ratings,
    )
}

from mosaicry.plans.exports import ORACLE as _EXPORTS  # noqa: E402
from mosaicry.plans.files import ORACLE as _FILES  # noqa: E402

_CTX = "(SELECT DISTINCT ON (file_id) * FROM file_contexts)"
_DOC = f"(SELECT id AS file_id, strftime(to_timestamp(mtime), '%Y:%m:%d %H:%M:%S') AS taken, metadata_date, metadata_location, file_size, derived_tags, vocab_terms FROM (SELECT DISTINCT ON (id) * FROM files) f LEFT JOIN {_CTX} c ON c.file_id = f.id)"
_FIELDS = f"""SELECT file_id, 'taken' AS canonical, CASE WHEN taken IS NOT NULL THEN 'EXIF:DateTimeOriginal' ELSE 'XMP:CreateDate' END AS tag, coalesce(taken, metadata_date) AS value FROM {_DOC} WHERE coalesce(taken, metadata_date) IS NOT NULL
UNION ALL SELECT file_id, 'place', 'XMP:Location', metadata_location FROM {_DOC} WHERE metadata_location IS NOT NULL UNION ALL SELECT file_id, 'size', 'File:FileSize', file_size::VARCHAR FROM {_DOC} WHERE file_size IS NOT NULL"""
_KEYS = f"SELECT DISTINCT file_id, canonical, trim(k) AS keyword FROM (SELECT file_id, 'keywords' AS canonical, unnest(derived_tags) AS k FROM {_DOC} UNION ALL SELECT file_id, 'terms', unnest(vocab_terms) FROM {_DOC}) WHERE trim(k) <> ''"
_CAM = f"(SELECT p_partkey AS id, {', '.join(f'{v} AS {k}' for k, v in (CAMERA | QUALITY).items())} FROM part)"
_BANDS = ((0, 4, "overnight"), (5, 5, "blue_hour_morning"), (6, 7, "golden_hour_morning"), (8, 10, "morning"), (11, 13, "midday"), (14, 16, "afternoon"), (17, 18, "golden_hour_evening"), (19, 19, "blue_hour_evening"), (20, 23, "night"))


def _range_sql(tag: str, field: str, lo: float | None, hi: float | None) -> str:
    field = "exif_width / exif_height" if field == "aspect_ratio" else field
    cond = " AND ".join([f"{field} IS NOT NULL"] + ([f"{field} >= {lo}"] if lo is not None else []) + ([f"{field} <= {hi}"] if hi is not None else []))
    return f"SELECT id, '{tag}' AS tag, 'technical' AS category FROM {_CAM} WHERE {cond}"


_TAG = f"(SELECT file_id, unnest(derived_tags) AS tag FROM {_CTX})"
_GROUPS = "SELECT norm, arg_min(term, (length(term), term)) AS canonical, list_sort(list(term)) AS terms FROM (SELECT DISTINCT {norm} AS norm, {term} AS term FROM {t}) WHERE norm <> '' AND term <> '' GROUP BY norm HAVING count(*) > 1"
_TAGS = _GROUPS.format(norm="lower(trim(tag))", term="tag", t=_TAG)
_VOC = f"(SELECT term, list_filter(terms, lambda x: x <> term) AS synonyms, CASE WHEN contains(term, ':') THEN true WHEN NOT contains(trim(term), ' ') THEN false ELSE true END AS w FROM (SELECT terms, unnest(terms) AS term FROM ({_TAGS})))"
_NORM = r"trim(regexp_replace(regexp_replace(lower(trim(location_name)), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_TOK = r"list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '(.)\.[^.]*$', '\1'), '[/\\.]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[-_\s]+'), lambda x: lower(trim(x))), lambda x: x <> ''))"
_PROMPT = "concat_ws(chr(10), {}, 'Describe what this file shows.', 'Focus on: people and places')".format(", ".join(f"CASE WHEN trim({c}) <> '' THEN '{k}: ' || trim({c}) END" for k, c in (("Date", "metadata_date"), ("Place", "metadata_location"), ("Tags", "array_to_string(derived_tags, ', ')"), ("Terms", "array_to_string(vocab_terms, ', ')"))))

ORACLE = {
    "metadata_fields": _FIELDS,
    "metadata_keywords": _KEYS,
    "unmapped_fields": " UNION ALL ".join(f"SELECT '{t}' AS tag, count(*) AS n FROM {_DOC} WHERE {c} IS NOT NULL" for t, c in (("XMP:Location", "metadata_location"), ("File:FileSize", "file_size"), ("IPTC:Keywords", "derived_tags"), ("XMP:Subject", "vocab_terms"))),
    "metadata_faces": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id, source ORDER BY id) - 1 AS place FROM (SELECT DISTINCT ON (id) * FROM meta_face_regions) WHERE file_id IS NOT NULL)
SELECT file_id, CASE WHEN source = 'mwg-rs' THEN source ELSE 'acdsee' END AS source, place, name, bbox_norm[1] AS cx, bbox_norm[2] AS cy, bbox_norm[3] AS w, bbox_norm[4] AS h FROM r WHERE name <> '' AND bbox_norm[1] IS NOT NULL AND bbox_norm[2] IS NOT NULL AND bbox_norm[3] IS NOT NULL AND bbox_norm[4] IS NOT NULL""",
    "camera_tags": " UNION ".join(
        [_range_sql(*r) for r in RANGES]
        + [f"SELECT id, CASE WHEN exif_width > exif_height THEN 'Landscape' ELSE 'Portrait' END, 'technical' FROM {_CAM} WHERE exif_width <> exif_height", f"SELECT id, 'Panoramic', 'technical' FROM {_CAM} WHERE exif_width / exif_height >= 2"]
        + [f"SELECT id, CASE WHEN flash IN (1, 3) THEN 'flash_fired' ELSE 'no_flash' END, 'technical' FROM {_CAM}"]
        + [f"SELECT id, '{t}', 'temporal' FROM {_CAM} WHERE id % 24 BETWEEN {a} AND {b}" for a, b, t in _BANDS]
    ),
    "life_event_tags": f"""WITH p AS (SELECT lower(trim(preferred_name)) AS who, min(id) AS id FROM people WHERE length(trim(preferred_name)) > 0 GROUP BY 1), e AS (SELECT id, trim(preferred_name) AS name, event, date::DATE AS ed FROM ({_EXPORTS['export_people_events']})),
n AS (SELECT DISTINCT file_id, lower(trim(name)) AS who FROM meta_face_regions), f AS (SELECT DISTINCT ON (id) id AS file_id, to_timestamp(mtime)::DATE AS fd FROM files),
j AS (SELECT *, year(fd) - year(ed) AS y FROM n JOIN p USING (who) JOIN e USING (id) JOIN f USING (file_id) WHERE month(fd) = month(ed) AND day(fd) = day(ed))
SELECT DISTINCT file_id, CASE event WHEN 'registered' THEN CASE WHEN y = 0 THEN name || '''s Birthday' ELSE name || '''s ' || y || 'th Birthday' END WHEN 'first heard' THEN CASE WHEN y = 0 THEN name || ' — Wedding Day' ELSE name || ' — ' || y || 'th Anniversary' END ELSE 'In memory of ' || name END AS tag FROM j""",
    "tag_spellings": f"SELECT norm, canonical, array_to_string(terms, '|') AS terms FROM ({_TAGS})",
    "place_spellings": "SELECT norm, canonical, array_to_string(terms, '|') AS terms FROM (" + _GROUPS.format(norm=_NORM, term="trim(location_name)", t="gps_proposals") + ")",
    "written_keywords": f"WITH t AS (SELECT DISTINCT file_id, tag FROM {_TAG} WHERE trim(tag) <> '') SELECT file_id, tag AS keyword FROM t UNION SELECT file_id, unnest(synonyms) FROM t JOIN {_VOC} ON term = tag WHERE w",
    "tag_synonyms": f"SELECT synonym, max(term) AS term FROM (SELECT term, unnest(synonyms) AS synonym FROM {_VOC}) GROUP BY 1",
    "taken_up_terms": f"""SELECT file_id, array_to_string(list_append(coalesce(derived_tags, []), 'weekend'), '|') AS tags FROM {_CTX}
WHERE list_contains(list_transform(list_concat(coalesce(derived_tags, []), coalesce(vocab_terms, [])), lambda x: lower(trim(x))), 'weekend') AND NOT coalesce(list_contains(derived_tags, 'weekend'), false)""",
    "normalised_files": rf"""WITH w AS (SELECT id, {_TOK.removeprefix("list_distinct(").removesuffix(")")} AS t FROM (SELECT DISTINCT ON (id) * FROM files)), t AS (SELECT id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM w),
u AS (SELECT id, list_filter(t, lambda x: regexp_matches(x, '^\d{{5}}$')) AS s, list_filter(t, lambda x: NOT regexp_matches(x, '^\d{{5}}$') AND x NOT IN ('copy', 'edit', 'roll', 'page')) AS k FROM t)
SELECT id, trim(replace(array_to_string(list_transform(k, lambda x: CASE x WHEN 'vid' THEN 'video' WHEN 'dsc' THEN 'picture' ELSE x END), ' '), 'album', 'book')) AS name, s[-1] AS sequence FROM u""",
    "open_tokens": rf"SELECT token, count(*) AS n_files FROM (SELECT id, unnest({_TOK}) AS token FROM (SELECT DISTINCT ON (id) * FROM files)) WHERE NOT regexp_matches(token, '^\d{{5}}$') AND token NOT IN ('copy', 'edit', 'vid', 'dsc', 'roll') GROUP BY 1",
    "normal_texts": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([0-9]+) ?m([ .,;])', '\1 metres\2', 'g'), '^ | $', '', 'g'), '(harbour) (survey)', '\2 of the \1', 'g') AS text FROM documents WHERE text IS NOT NULL",
    "open_terms": f"SELECT term, count(*) AS n_files FROM (SELECT DISTINCT file_id, trim(t) AS term FROM (SELECT file_id, unnest(vocab_terms) AS t FROM {_CTX})) WHERE term <> '' AND NOT regexp_matches(term, '^early |(barn|quay)$|^quiet depot$', 'i') GROUP BY 1",
    "file_prompts": f"SELECT file_id, {_PROMPT} AS prompt FROM {_CTX}",
    "enrichment_texts": f"""WITH v AS (SELECT file_id, 0 AS k, canonical AS o, value AS v FROM ({_FIELDS}) WHERE canonical <> 'size' UNION ALL SELECT DISTINCT file_id, 1, keyword, keyword FROM ({_KEYS}))
SELECT file_id, string_agg(v, ' ' ORDER BY k, o, v) AS text FROM v WHERE v <> '' GROUP BY 1""",
    "ratings": f"SELECT file_id, greatest(1, ceil(score * 5))::INT AS stars FROM ({_FILES['combined_scores']})",
}

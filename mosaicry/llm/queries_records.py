"""Queries on duplicate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.llm.survivors import current_scores, current_values, duplicate_groups, field_values, survivors
from mosaicry.operators.facts import pivot_max
from mosaicry.scratch import materialize
from mosaicry.tables import load, once

#: Fields whose values recur over groups, so that their order can be learned, and the others.
LEARNED = ("ext", "file_type", "source_id", "band")
FIELDS = {
    "filename": "string", "ext": "string", "file_type": "string", "source_id": "bigint", "file_size": "bigint", "sha256": "string",
    "mtime": "double", "ingested_at": "timestamp", "score": "double", "band": "string",
}


def _survivors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = load(spark, d, "files")
    groups = duplicate_groups(files, load(spark, d, "file_hashes"))
    return files, survivors(groups, files, current_scores(load(spark, d, "file_aesthetic")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)[1].select("file_id", "survivor_id")


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per group: survivor, its path, number of files, and the group's current value of every field of files and of the aesthetic rows.

    Rows of files are dated by mtime, aesthetic rows by scored_at. Blank texts are no
    values; ext and file_type count in lower case.
    """
    files, s = _survivors(spark, d)
    s = materialize(s, "survivors")
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = once(files, "id").join(s.withColumnRenamed("file_id", "id"), "id")
    own = {"filename": text("filename"), "ext": F.lower(text("ext")), "file_type": F.lower(text("file_type")), "source_id": F.col("source_id"), "file_size": F.col("file_size"), "sha256": text("sha256"), "mtime": F.col("mtime"), "ingested_at": F.unix_micros("ingested_at")}
    told = field_values(rows, "group_id", own, F.col("mtime"))
    shots = once(load(spark, d, "file_aesthetic"), "id").filter(F.col("model_name") == "nima_mobilenet").join(s, "file_id")
    score = F.when(F.col("score").between(0, 1), F.col("score"))
    told = told.unionByName(field_values(shots, "group_id", {"score": score, "band": text("band")}, F.unix_micros("scored_at")))
    now = pivot_max(current_values(told, LEARNED), "g", "field", "v", list(FIELDS))
    head = s.groupBy("group_id").agg(F.min("survivor_id").alias("survivor_id"), F.count("*").alias("n_files"))
    head = head.join(rows.filter("id = survivor_id").select("group_id", "path"), "group_id")
    typed = [(F.timestamp_micros(F.col(f).cast("bigint")) if t == "timestamp" else F.col(f).cast(t)).alias(f) for f, t in FIELDS.items()]
    return head.join(now.select(F.col("g").alias("group_id"), *typed), "group_id").select("group_id", "survivor_id", "n_files", "path", *FIELDS)


QUERIES = {"p7_found": p7_found, "p7_records": p7_records}

_P7 = r"""
WITH RECURSIVE f AS (SELECT DISTINCT ON (id) * FROM files WHERE file_size > 0),
h AS (SELECT DISTINCT file_id AS id, lower(trim(phash)) AS p FROM file_hashes JOIN f ON f.id = file_id WHERE regexp_matches(lower(trim(phash)), '^[0-9a-f]{16}$')),
hx AS (SELECT id, ('0x' || p)::UBIGINT AS b FROM h WHERE p <> '0000000000000000'),
e AS (
  SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.sha256 = b.sha256 AND a.id <> b.id
  UNION SELECT a.id, b.id FROM f a JOIN f b ON a.canonical_id = b.id AND a.id <> b.id
  UNION SELECT b.id, a.id FROM f a JOIN f b ON a.canonical_id = b.id AND a.id <> b.id
  UNION SELECT a.id, b.id FROM hx a JOIN hx b ON a.id <> b.id AND bit_count(xor(a.b, b.b)) <= 5),
reach AS (SELECT id AS node, id AS other FROM f WHERE id IN (SELECT a FROM e) UNION SELECT node, e.b FROM reach JOIN e ON e.a = other),
g AS (SELECT node, min(other) AS gid FROM reach GROUP BY node),
s AS (SELECT file_id, arg_max(coalesce(score, 9.0), (scored_at, id)) AS score FROM file_aesthetic WHERE model_name = 'nima_mobilenet' GROUP BY file_id),
r AS (SELECT g.node, gid, CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE -1 END AS score, file_size FROM g JOIN f ON f.id = g.node LEFT JOIN s ON s.file_id = g.node),
best AS (SELECT gid, arg_max(node, (score, file_size, -node)) AS survivor_id FROM r GROUP BY gid)
"""
# a learned order: neighbours of dated values, net support of two, closed transitively, without cycles
_P7_RECORDS = """
m AS (SELECT f.*, gid FROM f JOIN g ON g.node = f.id),
a0 AS (SELECT DISTINCT ON (id) * FROM file_aesthetic WHERE model_name = 'nima_mobilenet'),
told AS (
  SELECT gid, 'filename' AS field, nullif(trim(filename), '') AS v, mtime AS seen FROM m UNION ALL SELECT gid, 'ext', lower(nullif(trim(ext), '')), mtime FROM m
  UNION ALL SELECT gid, 'file_type', lower(nullif(trim(file_type), '')), mtime FROM m UNION ALL SELECT gid, 'source_id', source_id::VARCHAR, mtime FROM m
  UNION ALL SELECT gid, 'file_size', file_size::VARCHAR, mtime FROM m UNION ALL SELECT gid, 'sha256', nullif(trim(sha256), ''), mtime FROM m
  UNION ALL SELECT gid, 'ingested_at', epoch_us(ingested_at)::VARCHAR, mtime FROM m
  UNION ALL SELECT gid, 'score', score::VARCHAR, epoch_us(scored_at) FROM a0 JOIN g ON g.node = file_id WHERE score BETWEEN 0 AND 1
  UNION ALL SELECT gid, 'band', nullif(trim(band), ''), epoch_us(scored_at) FROM a0 JOIN g ON g.node = file_id),
vals AS (SELECT gid, field, v, max(seen) AS last, count(*) AS n FROM told WHERE v IS NOT NULL GROUP BY 1, 2, 3),
voc AS (SELECT field, v FROM vals WHERE field IN ('ext', 'file_type', 'source_id', 'band') GROUP BY 1, 2 HAVING count(*) >= 2),
step AS (SELECT field, lag(v) OVER w AS older, v AS newer, lag(last) OVER w AS b, last FROM vals JOIN voc USING (field, v) WHERE last IS NOT NULL WINDOW w AS (PARTITION BY gid, field ORDER BY last, v)),
cnt AS (SELECT field, older, newer, count(*) AS n FROM step WHERE older IS NOT NULL AND b < last GROUP BY 1, 2, 3),
dir AS (SELECT x.field, x.older, x.newer FROM cnt x LEFT JOIN cnt y ON x.field = y.field AND x.older = y.newer AND x.newer = y.older WHERE x.n - coalesce(y.n, 0) >= 2),
clo AS (SELECT * FROM dir UNION SELECT clo.field, clo.older, dir.newer FROM clo JOIN dir ON clo.field = dir.field AND clo.newer = dir.older),
ord AS (SELECT * FROM clo WHERE NOT EXISTS (SELECT 1 FROM clo c WHERE c.field = clo.field AND c.older = clo.newer AND c.newer = clo.older)),
grp AS (SELECT gid, field, max(last) AS top, count(*) > 1 AND count(last) < count(*) AND field IN ('ext', 'file_type', 'source_id', 'band') AS opened FROM vals GROUP BY 1, 2),
bt AS (SELECT x.gid, x.field, x.v, grp.opened AND (coalesce(x.last < top, false) OR EXISTS (
    SELECT 1 FROM ord JOIN vals y ON y.field = ord.field AND y.v = ord.newer WHERE ord.field = x.field AND ord.older = x.v AND y.gid = x.gid AND (x.last IS NULL OR y.last IS NULL))) AS beaten, x.last, x.n
  FROM vals x JOIN grp USING (gid, field)),
cur AS (SELECT gid, field, v FROM bt QUALIFY row_number() OVER (PARTITION BY gid, field ORDER BY beaten, last IS NULL, last DESC, n DESC, v) = 1),
mt AS (SELECT gid, max(mtime) AS mtime FROM m GROUP BY 1),
sz AS (SELECT gid, count(*) AS n_files FROM m GROUP BY 1),
wide AS (SELECT gid, """ + ", ".join(f"max(CASE WHEN field = '{f}' THEN v END) AS {f}" for f in FIELDS if f != "mtime") + """ FROM cur GROUP BY 1)
SELECT best.gid AS group_id, best.survivor_id, n_files, f.path, filename, wide.ext, wide.file_type, wide.source_id::BIGINT AS source_id, wide.file_size::BIGINT AS file_size, wide.sha256, mt.mtime,
  make_timestamp(wide.ingested_at::BIGINT) AS ingested_at, score::DOUBLE AS score, band
FROM best JOIN sz USING (gid) JOIN mt USING (gid) JOIN wide USING (gid) JOIN f ON f.id = best.survivor_id
"""

ORACLE = {"p7_found": _P7 + "SELECT node AS file_id, survivor_id FROM g JOIN best USING (gid)", "p7_records": _P7.rstrip() + "," + _P7_RECORDS.replace("filename, wide.ext", "wide.filename, wide.ext")}

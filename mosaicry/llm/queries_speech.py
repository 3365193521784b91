"""Queries on transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.llm.transcripts import speaker_turns, turn_texts
from mosaicry.tables import load


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(load(spark, d, "transcript_segments"), load(spark, d, "file_voice_segments"), load(spark, d, "people"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select(F.col("id").alias("segment_id"), "turn_id")


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their speakers and clean words, in rows of ten minutes at most."""
    return turn_texts(_turns(spark, d))


QUERIES = {"p3_found": p3_found, "p3_turns": p3_turns}

_BR = r"\[[^\]]*\]|\([^)]*\)|<[^>]*>|\*[^*]*\*|\{[^}]*\}"
_NAME = "nullif(lower(trim(regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '\\s*:\\s*$', ''))), '')"
_NUM = "CASE WHEN len(regexp_extract_all({c}, '\\d+')) = 1 THEN TRY_CAST(regexp_extract({c}, '\\d+') AS BIGINT) END"
_PREFIX = r"^(?:\s|♪|♫|>>|\[[^\]]*\]|\([^)]*\)|<[^>]*>|\*[^*]*\*|[.,?!-])*"
_P3 = rf"""
WITH s0 AS (SELECT file_id, start_ms, end_ms, text, min(id) AS id, arg_min(coalesce(speaker_label, ''), id) AS speaker_label
  FROM transcript_segments WHERE length(text) > 0 GROUP BY 1, 2, 3, 4),
s1 AS (SELECT *, regexp_extract(lower(text), '\d{{1,3}}:\d\d:\d\d') AS st,
   coalesce(nullif(regexp_extract(lower(text), '{_PREFIX}(?:speaker|spk|s)[\s_-]*(\d+)\s*:', 1), ''),
            nullif(regexp_extract(lower(text), '^(?:\s|♪|>>|<[^>]*>|\([^)]*\)|\[\d[^\]]*\])*\[(?:speaker|spk|s)[\s_-]*(\d+)\]', 1), ''))::BIGINT AS said,
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_BR}', ' ', 'g'), '♪|♫|>>|\d+:\d\d:\d\d', ' ', 'g'), '^[\s.,?!-]*(?:speaker|spk|s)[\s_-]*\d+\s*:', ' ', 'i'),
     '\b(?:u+m+|u+h+m*|e+r+m*|h+m+|a+h+)\b', ' ', 'gi') AS w FROM s0),
s2 AS (SELECT id, file_id, end_ms, coalesce(start_ms, CASE WHEN st <> '' THEN (split_part(st, ':', 1)::BIGINT * 3600 + split_part(st, ':', 2)::BIGINT * 60 + split_part(st, ':', 3)::BIGINT) * 1000 END) AS t,
   {_NAME.format(c="speaker_label")} AS label, said, w FROM s1 WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]')),
s3 AS (SELECT *, CASE WHEN label IS NULL THEN said ELSE {_NUM.format(c="label")} END AS num FROM s2),
v AS (SELECT file_id, start_ms, end_ms, person_id, {_NAME.format(c="speaker_label")} AS vl FROM file_voice_segments WHERE speaker_label IS NOT NULL),
v2 AS (SELECT *, {_NUM.format(c="vl")} AS vn FROM v),
h AS (SELECT s3.id, arg_max(coalesce(vn, -1), (least(s3.end_ms, v2.end_ms) - greatest(t, v2.start_ms), -v2.start_ms, -v2.end_ms)) AS vn FROM s3 JOIN v2 USING (file_id)
   WHERE label IS NULL AND num IS NULL AND least(s3.end_ms, v2.end_ms) > greatest(t, v2.start_ms) GROUP BY 1),
n AS (SELECT {_NAME.format(c="preferred_name")} AS name, min(id) AS person FROM people WHERE preferred_name IS NOT NULL GROUP BY 1),
pn AS (SELECT DISTINCT id, person FROM people JOIN n ON n.name = {_NAME.format(c="preferred_name")}),
vp AS (SELECT file_id, vn, min(person_id) AS pid FROM v2 WHERE vn IS NOT NULL AND person_id IS NOT NULL GROUP BY 1, 2),
s4 AS (SELECT s3.id, s3.file_id, t, w, CASE WHEN num IS NULL THEN label END AS name, coalesce(num, h.vn) AS num FROM s3 LEFT JOIN h USING (id)),
s5 AS (SELECT s4.*, coalesce(pn.person, vp.pid, n.person) AS person FROM s4 LEFT JOIN vp ON vp.file_id = s4.file_id AND vp.vn = s4.num LEFT JOIN pn ON pn.id = vp.pid LEFT JOIN n ON n.name = s4.name AND s4.num IS NULL),
s6 AS (SELECT *, coalesce('p' || person, 'n' || num, 'l' || name) AS spk FROM s5),
s7 AS (SELECT *, CASE WHEN spk IS NOT NULL AND lag(spk) OVER w = spk THEN NULL ELSE id END AS sid FROM s6 WINDOW w AS (PARTITION BY file_id ORDER BY t NULLS LAST, id)),
s8 AS (SELECT *, last_value(sid IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS turn_id FROM s7)
"""

ORACLE = {
    "p3_found": _P3 + "SELECT id AS segment_id, turn_id FROM s8",
    "p3_turns": _P3
    + r""", s9 AS (SELECT *, regexp_extract_all(w, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') AS ws FROM s8)
SELECT turn_id, file_id, coalesce(t // 600000, -1) AS part, min(person) AS person_id, count(*) AS n_segments, sum(len(ws))::BIGINT AS n_words, string_agg(array_to_string(ws, ' '), ' ' ORDER BY t, id) AS text
FROM s9 GROUP BY turn_id, file_id, part""",
}

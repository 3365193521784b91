"""Queries on texts and item lists."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.llm.cooccurrence import clean_items, pair_counts
from mosaicry.llm.leakage import leaked_items
from mosaicry.llm.lookalike import LOOKALIKES, consistent_texts, same_look_pairs
from mosaicry.tables import load


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ctx = load(spark, d, "file_contexts").select("file_id", clean_items("derived_tags", "vocab_terms").alias("items"))
    return pair_counts(ctx, "file_id", "items", min_together=3, min_lift=5.0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("item_a", "item_b")


def p6_association(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p6_found with their counts and strength."""
    return _pairs(spark, d)


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of items that occurs, with its counts and strength; nothing is cut."""
    ctx = load(spark, d, "file_contexts").select("file_id", clean_items("derived_tags", "vocab_terms").alias("items"))
    return pair_counts(ctx, "file_id", "items")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "text", min_words=12, whole_short=False)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold a passage of each item, zero included, and the largest share of it that one document holds."""
    items = load(spark, d, "eval_items").select("item_id", "task").dropDuplicates(["item_id"])
    n = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("containment").alias("containment"))
    return items.join(n, "item_id", "left").select("item_id", "task", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = same_look_pairs(load(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return consistent_texts(load(spark, d, "documents"), "doc_id", "text").withColumnsRenamed({"id": "doc_id", "form": "text"})


QUERIES = {"p10_found": p10_found, "p10_forms": p10_forms, "p6_found": p6_found, "p6_association": p6_association, "p6_pairs": p6_pairs, "p8_found": p8_found, "p8_report": p8_report}

_P6 = r"""
WITH base AS (
  SELECT DISTINCT file_id, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS item
  FROM (SELECT file_id, unnest(list_concat(coalesce(derived_tags, []), coalesce(vocab_terms, []))) AS x FROM file_contexts) WHERE x IS NOT NULL),
b AS (SELECT * FROM base WHERE item <> ''),
f AS (SELECT item, count(*) AS f FROM b GROUP BY item), t AS (SELECT count(DISTINCT file_id) AS n FROM b),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.file_id = y.file_id AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT p.*, fa.f AS n_a, fb.f AS n_b, n FROM p JOIN f fa ON fa.item = item_a JOIN f fb ON fb.item = item_b, t WHERE n_ab * n >= 5 * fa.f * fb.f)
"""
_P6_ALL = r"""
WITH base AS (
  SELECT DISTINCT file_id, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS item
  FROM (SELECT file_id, unnest(list_concat(coalesce(derived_tags, []), coalesce(vocab_terms, []))) AS x FROM file_contexts) WHERE x IS NOT NULL),
b AS (SELECT * FROM base WHERE item <> '' AND file_id IS NOT NULL),
f AS (SELECT item, count(*) AS f FROM b GROUP BY item), t AS (SELECT count(DISTINCT file_id) AS n FROM b),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.file_id = y.file_id AND x.item < y.item GROUP BY 1, 2),
r AS (SELECT p.*, fa.f AS n_a, fb.f AS n_b, n FROM p JOIN f fa ON fa.item = item_a JOIN f fb ON fb.item = item_b, t)
SELECT item_a, item_b, n_ab, n_a, n_b, n, n_ab * n / (n_a::DOUBLE * n_b) AS lift,
  (n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)) AS odds_ratio FROM r"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_P8 = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) > 11)),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) > 11)),
hit AS (SELECT doc_id, item_id, count(DISTINCT g) AS k FROM dg JOIN ig USING (g) GROUP BY 1, 2)
"""

# full-width forms are ASCII moved by a fixed distance; look-alikes become their Latin member
_FROM = "".join(map(chr, range(0xFF01, 0xFF5F))) + "".join(c for cls in LOOKALIKES for c in cls[1:] if c != ".") + "\u00a0\u2002\u2007\u2009\u202f\u3000\u3000"
_TO = "".join(map(chr, range(0x21, 0x7F))) + "".join(cls[0] for cls in LOOKALIKES for c in cls[1:] if c != ".") + " " * 7
_P10 = f"""
WITH f AS (
  SELECT doc_id, text, nfc_normalize(replace(replace(translate(regexp_replace(text, '[\u00ad\u200b-\u200f\u2060\ufeff]', '', 'g'), '{_FROM.replace("'", "''")}', '{_TO.replace("'", "''")}'), '\ufb01', 'fi'), '\ufb02', 'fl')) AS form
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT * FROM f WHERE regexp_matches(form, '\\S'))
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
"""

# letters of no class tell a script; a word takes its own script, or that of the text if it has none
_IN = {k: [(cls[0], cls[i]) for cls in LOOKALIKES if len(cls) > i and cls[i] != "."] for k, i in (("c", 1), ("g", 2))}
_MOVE = {k: "translate(w, '{}', '{}')".format("".join(a for a, _ in v), "".join(b for _, b in v)) for k, v in _IN.items()}
_TELLS = {"c": "[\\x{0400}-\\x{052f}]", "g": "[\\x{0370}-\\x{03ff}\\x{1f00}-\\x{1fff}]", "l": "[" + "".join(c for c in string.ascii_letters if c not in {cls[0] for cls in LOOKALIKES}) + "]"}
_P10_FORMS = f"""{_P10[:_P10.index("FROM documents WHERE text IS NOT NULL),")]}FROM documents),
t AS (SELECT doc_id, form, regexp_extract_all(form, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') AS ws, len(regexp_extract_all(form, '{_TELLS["c"]}')) AS c, len(regexp_extract_all(form, '{_TELLS["g"]}')) AS g, len(regexp_extract_all(form, '{_TELLS["l"]}')) AS l FROM f),
m AS (SELECT *, CASE WHEN l >= c AND l >= g THEN 'l' WHEN c >= g THEN 'c' ELSE 'g' END AS main FROM t)
SELECT doc_id, CASE WHEN form IS NULL THEN NULL ELSE nfc_normalize(array_to_string(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '{_TELLS["c"]}') THEN {_MOVE["c"]} WHEN regexp_matches(w, '{_TELLS["g"]}') THEN {_MOVE["g"]}
  WHEN regexp_matches(w, '{_TELLS["l"]}') THEN w WHEN main = 'c' THEN {_MOVE["c"]} WHEN main = 'g' THEN {_MOVE["g"]} ELSE w END), '')) END AS text FROM m
"""

ORACLE = {
    "p10_forms": _P10_FORMS,
    "p10_found": _P10,
    "p6_found": _P6 + "SELECT item_a, item_b FROM r",
    "p6_association": _P6
    + """SELECT item_a, item_b, n_ab, n_a, n_b, n, n_ab * n / (n_a::DOUBLE * n_b) AS lift,
  (n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)) AS odds_ratio FROM r""",
    "p6_pairs": _P6_ALL,
    "p8_found": _P8 + "SELECT doc_id, item_id FROM hit",
    "p8_report": _P8 + ", m AS (SELECT item_id, count(DISTINCT g) AS m FROM ig GROUP BY 1), n AS (SELECT item_id, count(*) AS n_docs, max(k / m) AS c FROM hit JOIN m USING (item_id) GROUP BY item_id) SELECT item_id, task, coalesce(n_docs, 0) AS n_docs, coalesce(c, 0) AS containment FROM (SELECT DISTINCT ON (item_id) item_id, task FROM eval_items) LEFT JOIN n USING (item_id)",
}

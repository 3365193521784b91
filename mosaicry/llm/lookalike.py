"""Texts that look the same brought to one form.

A text first loses its ignorable characters and gets its compatibility form. What
is left differs only in letters of other scripts that look alike. Each letter
stands for its class of look-alikes, so a token is a lattice with one column per
letter; Viterbi takes the path that the character bigrams of the corpus and the
consistency of scripts make likeliest. The lattice is built from classes, never
from the letter that was typed, and so two texts of the same look always get the
same form.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.skew import salted_join
from mosaicry.scratch import materialize

# Letters that look alike, in the order Latin, Cyrillic, Greek, a dot where a script has none; after them
# letters of Armenian and Cherokee and further Latin and Cyrillic ones. Compatibility forms (full-width, mathematical and the like) need no entry.
LOOKALIKES = (
    "AАΑᎪ BВΒᏴ CС.Ꮯ D..Ꭰ EЕΕᎬ F.Ϝ GԌ.Ꮐ HНΗᎻ IІΙӀ JЈͿᎫ KКΚᏦ L..Ꮮ MМΜᎷ N.Ν OОΟՕ PРΡᏢ QԚ. R..Ꭱ SЅ.ՏᏚ TТΤᎢ U..Ս VѴ.Ꮩ WԜ.Ꮃ XХΧ YУΥҮ Z.ΖᏃ "
    "aаαɑ bЬ. cс. dԁ. eе. g..ɡց hһ.հ iіιı jјϳ lӏ. n.ηո oоοօ pрρ qԛ.զ sѕ. u.υս vѵν wԝ. xхχ yуγү"
).split()
# Punctuation of one look that compatibility forms keep apart.
PUNCTUATION = {"‐": "-", "‑": "-", "−": "-", "ʼ": "'"}

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
_CLASS = {ch: cls for cls in LOOKALIKES for ch in cls if ch != "."}
_TO_FIRST = str.maketrans({ch: cls[0] for ch, cls in _CLASS.items()} | PUNCTUATION)
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ\u0530-\u058f\u13a0-\u13ff\uab70-\uabbfἀ-῿]")
_TOKEN = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
#: Least log-probability of a letter after another. Log-probability of leaving a script inside a token, and of a
#: letter outside the main script; each is less than FLOOR, so no bigram makes up for a letter of another script.
FLOOR, SWITCH, OUTSIDE = -7.6, -12.0, -9.0


class _Tidy(dict):
    """Code point to what stands for it: nothing for ignorable ones, a space for blanks. Filled as met."""

    def __missing__(self, o: int) -> int | None:
        kind = unicodedata.category(chr(o))
        drop = kind == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF
        self[o] = to = None if drop else 32 if kind == "Zs" else o
        return to


_TIDY = _Tidy()


@functools.cache
def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER")


def compatible(text: str) -> str:
    """Compatibility decomposition without ignorable characters; every kind of blank is a space."""
    return text if text.isascii() else unicodedata.normalize("NFKD", text.translate(_TIDY)).translate(_TIDY)


def consistent(text: str, score=None, memo: dict | None = None) -> str:
    """The one form of ``text``; ``score(a, b)`` is the log-probability of letter b after a."""
    text = compatible(text)
    if text.isascii():
        return text
    shape = text.translate(_TO_FIRST)
    if not _FOREIGN.search(shape):
        # Every letter that belongs to no class is Latin or of no script, so Latin is the best path throughout: a run of r
        # letters of another script inside a token costs 9 r, and its r + 1 bigrams gain 7.6 each at most, less 24 for the two
        # switches; a whole token of them has only r - 1 bigrams.
        return unicodedata.normalize("NFC", shape)
    own = Counter(s for c in shape if c.isalpha() and c not in _CLASS and (s := _script(c)) != "OTHER")
    main = max(SCRIPTS, key=lambda s: (own[s], -SCRIPTS.index(s)))
    memo = {} if memo is None else memo
    score = score or (lambda a, b: 0.0)

    def best(m: re.Match) -> str:
        k = (main, m[0])
        if k not in memo:
            memo[k] = _viterbi(m[0], main, score)
        return memo[k]

    return unicodedata.normalize("NFC", _TOKEN.sub(best, shape))


@functools.cache
def _members(cls: str) -> dict[str, str]:
    """The first letter of each script in a class."""
    out: dict[str, str] = {}
    for x in cls:
        if x != ".":
            out.setdefault(_script(x), x)
    return out


def _viterbi(token: str, main: str, score) -> str:
    """The likeliest spelling of a token given as first members of its classes."""
    own = Counter(s for c in token if c not in _CLASS and (s := _script(c)) != "OTHER")
    main = max(own, key=lambda s: (own[s], s == main, -SCRIPTS.index(s))) if own else main
    paths = {("", "OTHER"): (0.0, "")}
    for c in token:
        cls = _CLASS.get(c)
        choice = [(c, _script(c))] if cls is None else [(x, s) for s, x in _members(cls).items()]
        step = {}
        for x, s in choice:
            at = 0.0 if cls is None or s == main else OUTSIDE
            step[(x, s)] = max(((p + at + score(a, x) + (SWITCH if "OTHER" not in (s, t) and s != t else 0.0), form + x) for (a, t), (p, form) in paths.items()), key=lambda r: (r[0], r[1]))
        paths = step
    return max(paths.values(), key=lambda r: (r[0], r[1]))[1]


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, words = Counter(), Counter()

    def add() -> None:
        for w, k in words.items():
            if _script(w[0]) in SCRIPTS and {_script(c) for c in w if c.isalpha()} == {_script(w[0])}:
                for pair in zip(w, w[1:]):
                    n[pair] += k
        words.clear()

    for b in batches:
        for t in b.column(0).to_pylist():
            words.update(_TOKEN.findall(compatible(t)))
        if len(words) > 200_000:
            add()
    add()
    rows = [(a, b, c) for (a, b), c in n.items()]
    yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "n": pa.array([r[2] for r in rows], pa.int64())}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))


def bigram_model(texts: DataFrame, text: str) -> dict[tuple[str, str], float]:
    """log P(b | a) of letters inside tokens of one script, over all texts.

    Counted map-side; at most one number per pair of letters of three scripts
    reaches the driver, however large the corpus is.
    """
    t = texts.select(F.col(text).alias("t")).filter("t IS NOT NULL")
    n = t.mapInArrow(_count_bigrams, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    rows = n.collect()
    total: Counter = Counter()
    for r in rows:
        total[r["a"]] += r["n"]
    return {(r["a"], r["b"]): max(FLOOR, math.log((r["n"] + 0.5) / (total[r["a"]] + 50.0))) for r in rows}


def consistent_texts(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, form): every text in its one consistent form; null stays null, other columns are left out.

    Letter case, accents, digits and line breaks are kept; a text that already is in
    the form comes out unchanged.
    """
    model = bigram_model(texts, text)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        score = lambda a, b: model.get((a, b), FLOOR) if a else 0.0
        for b in batches:
            if len(memo) > 200_000:
                memo.clear()
            out = [None if t is None else consistent(t, score, memo) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "form"])

    src = texts.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    return src.mapInArrow(forms, f"id {src.schema['id'].dataType.simpleString()}, form string")


def same_look_pairs(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_a, id_b) of texts that differ as strings but have one form, id_a < id_b.

    Blank and null texts count for nothing; exact copies do not pair with each other
    but each pairs with every differing text of its look. Ids must be unique. Only
    fingerprints are shuffled, and only of looks with two spellings or more; a look
    that many documents share is cut into parts.
    """
    forms = consistent_texts(texts.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, F.struct(F.sha2(F.col(text), 256).alias("h"), F.col(text).alias("t")).alias("s")).select(F.struct(F.col(id_col).alias("i"), F.col("s.h").alias("h")).alias("k"), F.col("s.t").alias("t")), "k", "t")
    forms = forms.filter(F.col("form").rlike(r"\S"))
    f = materialize(forms.select(F.col("id.i").alias("id"), F.col("id.h").alias("spelling"), F.sha2("form", 256).alias("look")), "looks")
    several = f.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).filter("lo < hi").select("look")
    f = materialize(f.join(several, "look", "left_semi"), "looks")
    a = f.select("look", F.col("id").alias("id_a"), F.col("spelling").alias("sa"))
    b = f.select("look", F.col("id").alias("id_b"), F.col("spelling").alias("sb"))
    return salted_join(a, b, "look", "id_a").filter("id_a < id_b AND sa <> sb").select("id_a", "id_b")

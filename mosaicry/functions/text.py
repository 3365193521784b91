"""Tokens of file names and paths, term cleaning and small text helpers, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of places where a capital begins a new word inside a name.
_HUMP = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def path_tokens(path: Column) -> Column:
    """Distinct lower-case tokens in order: cut at separators, dots, dashes, blanks, underscores and word humps."""
    spaced = F.regexp_replace(F.regexp_replace(path, r"[/\\.]", " "), _HUMP, " ")
    return F.array_distinct(F.filter(F.transform(F.split(spaced, r"[-_\s]+"), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def _between(t: Column, start: int, n: int, lo: int, hi: int) -> Column:
    return F.substring(t, start, n).try_cast("int").between(lo, hi)


def token_class(t: Column) -> Column:
    """struct(pattern_class, semantic_type) of one token."""
    low = F.lower(t)
    cls = lambda a, b: F.struct(F.lit(a).alias("pattern_class"), F.lit(b).alias("semantic_type"))
    date8 = _between(low, 1, 4, 1900, 2099) & _between(low, 5, 2, 1, 12) & _between(low, 7, 2, 1, 31)
    date6 = _between(low, 3, 2, 1, 12) & _between(low, 5, 2, 1, 31)
    time6 = _between(low, 1, 2, 0, 23) & _between(low, 3, 2, 0, 59)
    six, eight = low.rlike("^[0-9]{6}$"), low.rlike("^[0-9]{8}$")
    return (
        F.when(t.rlike("^[A-Z]{1,4}-[0-9]{1,5}$"), cls("route_code", "code"))
        .when((t != low) & t.rlike(_HUMP), cls("camelcase", "compound"))
        .when(eight & date8, cls("8digit_numeric", "date")).when(eight, cls("8digit_numeric", "unclassified"))
        .when(six & date6, cls("6digit_numeric", "date")).when(six & time6, cls("6digit_numeric", "time")).when(six, cls("6digit_numeric", "unclassified"))
        .when(low.rlike("^[0-9]{3,4}$"), cls("sequential", "sequential"))
        .when(low.rlike("^[a-z0-9]+$"), cls("word", "word")).otherwise(cls("word", "unclassified"))
    )


def token_proposal(semantic: Column) -> Column:
    """struct(action, extract_as) that is proposed for a semantic type."""
    take = {"date": "file_date", "time": "file_time", "code": "route_number"}
    action = F.when(semantic.isin(*take), "capture").when(semantic == "sequential", "ignore").otherwise("none")
    name = F.coalesce(*[F.when(semantic == k, v) for k, v in take.items()], F.lit(""))
    return F.struct(action.alias("action"), name.alias("extract_as"))


def clean_term(t: Column) -> Column:
    """Without non-word characters at either end; null if nothing is left."""
    c = F.regexp_replace(t, r"(?U)^[\W_]+|[\W_]+$", "")
    return F.when(c != "", c)


def normal_name(t: Column) -> Column:
    """Lower case without punctuation, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", ""), r"\s+", " "))


def template(format_str: str | None, text: Column, pattern: str) -> Column:
    """``format_str`` with {N} and {N:s:e} replaced by groups of ``pattern`` in ``text``; empty gives group 1, or the whole match."""
    has_group = re.compile(pattern).groups > 0
    if not format_str:
        return F.regexp_extract(text, pattern, 1 if has_group else 0)
    out, at = [], 0
    for m in re.finditer(r"\{(\d+)(?::(\d+):(\d+))?\}", format_str):
        out.append(F.lit(format_str[at : m.start()]))
        g = F.regexp_extract(text, pattern, int(m[1]))
        out.append(F.substring(g, int(m[2]) + 1, max(0, int(m[3]) - int(m[2]))) if m[2] else g)
        at = m.end()
    return F.concat(*out, F.lit(format_str[at:]))


def word_list(text: Column) -> Column:
    """The words of a text between blanks."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that overlap by ``overlap``; the last one ends with the text. Empty texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    words = word_list(text)
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, size), " "))


def name_parts(full: Column) -> Column:
    """struct(first, middle, last): one part is a first name, of three and more the inner ones are middle names."""
    p = F.split(F.trim(F.regexp_replace(full, r"\s+", " ")), " ")
    n = F.size(p)
    return F.struct(
        F.get(p, F.lit(0)).alias("first"),
        F.when(n > 2, F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), " ")).alias("middle"),
        F.when(n > 1, F.element_at(p, -1)).alias("last"),
    )


#: A timestamp in a text, in brackets or with hours: four groups (hours, minutes, seconds, fraction) for either.
STAMP = r"[\[({<*]\s*(?:(\d{1,3}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?\s*[\])}>*]|(?:^|[^\d])(\d{1,3}):(\d{2}):(\d{2})(?:[.,](\d{1,3}))?"


def stamp_ms(text: Column) -> Column:
    """The first timestamp written in a text, in milliseconds; null if there is none."""
    part = lambda i: F.concat(F.regexp_extract(text, STAMP, i), F.regexp_extract(text, STAMP, i + 4))
    number = lambda c: F.when(c != "", c.cast("long")).otherwise(0)
    ms = ((number(part(1)) * 60 + number(part(2))) * 60 + number(part(3))) * 1000 + number(F.rpad(part(4), 3, "0"))
    return F.when(text.rlike(STAMP), ms)


def folder(path: Column) -> Column:
    """The parent folder with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/[^/]*$", "")

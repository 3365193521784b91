"""Facts out of metadata documents: fields by priority, keywords, face regions, rule inputs, keywords with synonyms, events of lives."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _document(document: str) -> Column:
    return F.from_json(F.col(document), "map<string,string>")


def _list(raw: Column) -> Column:
    """A JSON list, or a single value as a list of one; null for null."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def extracted_fields(rows: DataFrame, key: str, document: str, field_map: list[dict]) -> DataFrame:
    """(key, canonical, tag, value): each canonical field from the present tag of the smallest priority.

    ``field_map`` has canonical, tag, priority and type; those of type keyword_list are left to
    extracted_keywords. Null values count as absent; malformed documents give nothing.
    """
    groups: dict[str, list[dict]] = {}
    for r in sorted(field_map, key=lambda r: r.get("priority", 1)):
        groups.setdefault(r["canonical"], []).append(r)
    m = F.col("_m")
    found = []
    for name, rs in groups.items():
        if rs[0].get("type") == "keyword_list":
            continue
        one = F.coalesce(*[F.when(F.try_element_at(m, F.lit(r["tag"])).isNotNull(), F.struct(F.lit(r["tag"]).alias("tag"), F.try_element_at(m, F.lit(r["tag"])).alias("value"))) for r in rs])
        found.append(F.struct(F.lit(name).alias("canonical"), one.alias("f")))
    t = rows.select(F.col(key), _document(document).alias("_m")).select(key, F.explode(F.array(*found)).alias("x"))
    return t.filter("x.f IS NOT NULL").select(key, "x.canonical", "x.f.tag", "x.f.value")


def extracted_keywords(rows: DataFrame, key: str, document: str, field_map: list[dict]) -> DataFrame:
    """(key, canonical, keyword): the trimmed, non-blank items of each list field, each once; its first tag alone counts."""
    first: dict[str, dict] = {}
    for r in sorted(field_map, key=lambda r: r.get("priority", 1)):
        if r.get("type") == "keyword_list":
            first.setdefault(r["canonical"], r)
    lists = F.array(*[F.struct(F.lit(c).alias("canonical"), _list(F.try_element_at(F.col("_m"), F.lit(r["tag"]))).alias("items")) for c, r in first.items()])
    t = rows.select(F.col(key), _document(document).alias("_m")).select(key, F.explode(lists).alias("x"))
    return t.select(key, "x.canonical", F.explode("x.items").alias("k")).select(key, "canonical", F.trim("k").alias("keyword")).filter("keyword <> ''").distinct()


def unmapped_tags(rows: DataFrame, document: str, known: list[str], mapped: list[str] = ()) -> DataFrame:
    """(tag, n): the known tags that occur in documents and are not mapped yet, with the number of documents."""
    t = rows.select(F.explode(F.map_keys(_document(document))).alias("tag"))
    return t.filter(F.col("tag").isin(*known) & ~F.col("tag").isin(*mapped, "")).groupBy("tag").agg(F.count("*").alias("n"))


def face_regions(rows: DataFrame, key: str, document: str, prefixes: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, source, place, name, cx, cy, w, h) of regions given as parallel arrays in a metadata document.

    ``prefixes`` says for each source what its tags begin with: the first names Name, Type and
    AreaUnit, all of them in turn may hold AreaX, AreaY, AreaW and AreaH, and for each region the first whose X is known decides.
    Single values count as lists of one. Regions without a name, of a type other than
    face or blank, in other units than normalized, or without four numbers are left out.
    """
    at = lambda tag: _list(F.get_json_object(F.col("_doc"), f"$.{tag}"))
    out = None
    for source, ps in prefixes.items():
        head = ps[0]
        arrays = {f"a{i}{c}": at(f"{p}Area{c}") for i, p in enumerate(ps[1:] or ps) for c in "XYWH"}
        t = rows.select(F.col(key), F.col(document).alias("_doc"))
        t = t.select(key, at(f"{head}Name").alias("names"), at(f"{head}Type").alias("types"), F.coalesce(F.get_json_object("_doc", f"$.{head}AreaUnit"), F.lit("normalized")).alias("unit"), *[c.alias(n) for n, c in arrays.items()])
        t = t.filter("unit = 'normalized'").select("*", F.posexplode("names").alias("place", "name"))
        pick = F.coalesce(*[F.when(F.get(f"a{i}X", F.col("place")).isNotNull(), F.struct(*[F.get(f"a{i}{c}", F.col("place")).try_cast("double").alias(n) for c, n in zip("XYWH", ("cx", "cy", "w", "h"))])) for i in range(len(ps[1:] or ps))])
        kind = F.lower(F.coalesce(F.get("types", F.col("place")), F.lit("")))
        t = t.filter((F.col("name") != "") & kind.isin("face", "")).select(key, F.lit(source).alias("source"), F.col("place").cast("long").alias("place"), "name", pick.alias("b"))
        t = t.select(key, "source", "place", "name", "b.cx", "b.cy", "b.w", "b.h").filter("cx IS NOT NULL AND cy IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")
        out = t if out is None else out.unionByName(t)
    return out


# What the tags of face regions begin with, by source.
REGION_TAGS = {"mwg-rs": ("Region",), "acdsee": ("ACDSeeRegion", "ACDSeeRegionDLY", "ACDSeeRegionALG")}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def overlaid(base: Column, over: Column) -> Column:
    """The entries of two maps; those of ``over`` win."""
    return bound(over, lambda o: F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(o), k)), o))


def _map_of(values: dict[str, Column]) -> Column:
    """A map of the values that are not null."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(each, lambda e: e["v"].isNotNull()))


def rule_fields(captured: Column, metadata: Column, ext: Column, quality: dict[str, Column] | None = None) -> Column:
    """What rules look at: captured fields before metadata fields, and what follows from them.

    Derived: file_format, gps_present, hour_of_day (of exif_date_taken with T or a blank before the
    time), flash_fired (the lowest bit of flash), aspect_ratio, and the measures in ``quality``.
    """
    empty = F.create_map().cast("map<string,string>")

    def derive(f: Column) -> Column:
        get = lambda k: F.try_element_at(f, F.lit(k))
        number = lambda k: get(k).try_cast("double")
        taken = get("exif_date_taken")
        w, h = number("exif_width"), number("exif_height")
        derived = {
            "file_format": F.when(ext != "", F.lower(F.regexp_replace(ext, r"^\.+", ""))),
            "gps_present": F.when(get("exif_gps_lat") != "", F.lit("true")),
            "hour_of_day": F.when(F.substring(taken, 11, 1).isin("T", " "), F.substring(taken, 12, 2).try_cast("int")),
            "flash_fired": number("flash").cast("bigint").bitwiseAND(1),
            "aspect_ratio": F.when((w > 0) & (h > 0), w / h),
            **(quality or {}),
        }
        return overlaid(f, _map_of(derived))

    # each map holds the one below it many times: unbound, one row's fields are worked out thousands of times
    return bound(overlaid(F.coalesce(metadata, empty), F.coalesce(captured, empty)), derive)


def resolved_keywords(tags: DataFrame, key: str, tag: str, vocabulary: DataFrame, include_synonyms: bool) -> DataFrame:
    """(key, keyword): each key's tags and the synonyms of those whose term says so, each once.

    vocabulary: term, synonyms (array), write_synonyms (null: as ``include_synonyms``).
    """
    t = tags.filter(F.col(tag).isNotNull()).select(key, F.col(tag).alias("term")).distinct()
    v = vocabulary.filter(F.coalesce("write_synonyms", F.lit(include_synonyms))).select("term", F.explode("synonyms").alias("keyword"))
    return t.select(key, F.col("term").alias("keyword")).unionByName(t.join(v, "term").select(key, "keyword")).filter("keyword IS NOT NULL").distinct()


def synonym_map(vocabulary: DataFrame) -> DataFrame:
    """(synonym, term): what each synonym stands for; of several terms the last by alphabet."""
    return vocabulary.select("term", F.explode("synonyms").alias("synonym")).groupBy("synonym").agg(F.max("term").alias("term"))


def with_synonyms(vocabulary: DataFrame, new: DataFrame) -> DataFrame:
    """``vocabulary`` (term, synonyms) with the synonyms of ``new`` (term, synonym) it lacks, in alphabetic order behind its own."""
    n = new.groupBy("term").agg(F.array_sort(F.collect_set("synonym")).alias("_n"))
    none = F.array().cast("array<string>")
    old = F.coalesce("synonyms", none)
    return vocabulary.join(n, "term", "left").withColumn("synonyms", F.concat(old, F.array_except(F.coalesce("_n", none), old))).drop("_n")


def with_term(tags: Column, proposed: Column, term: str) -> Column:
    """``tags`` with ``term`` at their end, if it was proposed and is not among them; null otherwise."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.array_contains(proposed, term) & ~F.array_contains(tags, term), F.array_append(tags, term))


def parsed_reply(reply: Column) -> Column:
    """struct(tags, refined, new_terms) of a reply that should be a JSON object; empty for anything else."""
    r = F.from_json(reply, "tags array<string>, refined_description string, new_terms array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(r["tags"], none).alias("tags"), F.coalesce(r["refined_description"], F.lit("")).alias("refined"), F.coalesce(r["new_terms"], none).alias("new_terms"))


def spelling_groups(names: DataFrame, name: str, norm: Column) -> DataFrame:
    """(norm, canonical, terms): spellings that are one after ``norm``, two at least; the shortest is canonical (ties: the first by alphabet)."""
    t = names.filter(F.col(name).isNotNull()).select(norm.alias("norm"), F.col(name).alias("term")).filter("norm <> '' AND term <> ''").distinct()
    g = t.groupBy("norm").agg(F.min(F.struct(F.length("term").alias("n"), "term")).alias("b"), F.array_sort(F.collect_set("term")).alias("terms"))
    return g.filter(F.size("terms") > 1).select("norm", F.col("b.term").alias("canonical"), "terms")


def life_event_tag(file_date: Column, name: Column, event: Column, event_date: Column) -> Column:
    """The tag of a birth, marriage or death on the day of a file; null on other days.

    Dates are text, year first. Without a day in its date a birth or death holds for the whole
    month; a marriage needs both days. The years between are counted with "th" throughout.
    """
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    month = part(file_date, 6, 2) == part(event_date, 6, 2)
    whole = F.length(event_date) >= 10
    day = part(file_date, 9, 2) == part(event_date, 9, 2)
    years = part(file_date, 1, 4) - part(event_date, 1, 4)
    birth = F.when(years == 0, F.concat(name, F.lit("'s Birthday"))).otherwise(F.concat(name, F.lit("'s "), years, F.lit("th Birthday")))
    marriage = F.when(years == 0, F.concat(name, F.lit(" — Wedding Day"))).otherwise(F.concat(name, F.lit(" — "), years, F.lit("th Anniversary")))
    some = month & (~whole | F.coalesce(day, F.lit(False)))
    return F.when((event == "birth") & some, birth).when((event == "marriage") & month & whole & day, marriage).when((event == "death") & some, F.concat(F.lit("In memory of "), name))


def substituted(text: Column, rules: list[tuple[str, str]]) -> Column:
    r"""``text`` after all (pattern, replacement) in order; groups are written \1."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$")))
    return text


def matches_any(text: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Whether one of (pattern, is_regex) is found in ``text``, whatever the case; a plain one must be the whole text."""
    some = [p if regex else "^" + "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in p) + "$" for p, regex in patterns]
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in some)) if some else F.lit(False)


def prompt(lines: dict[str, Column], base: str, focus: str | None = None) -> Column:
    """A line ``label: value`` for every value that is not blank, the base text, and the focus if there is one."""
    told = [F.when(F.trim(v) != "", F.concat(F.lit(k + ": "), F.trim(v))) for k, v in lines.items()]
    return F.concat_ws("\n", *told, F.lit(base), *([F.lit("Focus on: " + focus)] if focus else []))

"""Declarative rules compiled to columns: tags of files, and normalised names.

A rule set is turned into one expression per rule at planning time, so a table is
tagged in one pass inside generated code.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.functions.dates import DAY_BANDS, FEASTS, NTH_FEASTS, decade, easter, nth_weekday, precise_enough
from mosaicry.functions.text import path_tokens, template


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _parts(d: Column) -> tuple[Column, Column, Column]:
    p = F.split(d, "-")
    return F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int"), F.substring(F.get(p, F.lit(2)), 1, 2).try_cast("int")


def _config(rule: dict) -> dict:
    cfg = rule.get("match_config") or {}
    return json.loads(cfg) if isinstance(cfg, str) else cfg


#: Computed rules for the n-th weekday of a month.
_NTH = {"thanksgiving_ca": "Canadian Thanksgiving", "thanksgiving_us": "US Thanksgiving", "mothers_day": "Mother's Day", "fathers_day": "Father's Day"}


class _Seen:
    """What rules look at, as columns worked out once a row: texts of fields, then what they say, then feasts."""

    def __init__(self, fields: str) -> None:
        self.fields = F.col(fields)
        self.layers: list[dict[tuple, tuple[str, Column]]] = [{}, {}, {}]

    def _keep(self, level: int, value: Column, *what) -> Column:
        layer = self.layers[level]
        layer.setdefault(what, (f"_{level}_{len(layer)}", value))
        return F.col(layer[what][0])

    def text(self, name: str) -> Column:
        return self._keep(0, F.try_element_at(self.fields, F.lit(name)), name)

    def lower(self, name: str) -> Column:
        return self._keep(1, F.lower(self.text(name)), "lower", name)

    def number(self, name: str) -> Column:
        return self._keep(1, _number(self.text(name)), "number", name)

    def parts(self, name: str) -> list[Column]:
        return [self._keep(1, c, "part", name, i) for i, c in enumerate(_parts(self.text(name)))]

    def exact(self, name: str, least: str | None) -> Column:
        return self._keep(1, precise_enough(self.text(name), least, self.text("file_date_precision")), "exact", name, least)

    def decade(self) -> Column:
        return self._keep(1, decade(F.substring(self.text("file_date"), 1, 4).try_cast("int")), "decade")

    def feast(self, algorithm: str) -> Column:
        year, month, day = self.parts("file_date")
        if algorithm == "easter":
            m, d = easter(year)
        else:
            m, weekday, n = NTH_FEASTS[_NTH[algorithm]]
            d = nth_weekday(year, m, weekday, n)
        return self._keep(2, (month == m) & (day == d), algorithm)

    def added(self, rows: DataFrame, key: str) -> DataFrame:
        rows = rows.select(key, *[c.alias(n) for n, c in self.layers[0].values()])
        for layer in self.layers[1:]:
            rows = rows.select("*", *[c.alias(n) for n, c in layer.values()])
        return rows


def compile_rule(rule: dict, seen: _Seen) -> Column:
    """The tag of ``rule`` where it fires on what was seen of a row, else null.

    match_type is one of month_day, month_range, range (both ends included),
    comparison, exact, in_list (case ignored) and computed. A missing field, a value
    that is no number or date, or too coarse a date does not fire.
    """
    cfg = _config(rule)
    kind, tag, name, least = rule["match_type"], F.lit(rule["result_tag"]), rule.get("field_name") or "", rule.get("minimum_precision")
    if kind in ("month_day", "month_range"):
        _, month, day = seen.parts(name)
        hit = (month == cfg["month"]) & (day == cfg["day"]) if kind == "month_day" else month.isin(*cfg["months"])
        return F.when(hit & seen.exact(name, least), tag)
    if kind == "range":
        x = seen.number(name)
        hit = x.isNotNull()
        if cfg.get("min") is not None:
            hit = hit & (x >= float(cfg["min"]))
        if cfg.get("max") is not None:
            hit = hit & (x <= float(cfg["max"]))
        return F.when(hit, tag)
    if kind == "comparison":
        a, b = seen.number(cfg.get("field_a", "")), seen.number(cfg.get("field_b", ""))
        ops = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b}
        return F.when(ops.get(cfg.get("op", ">"), F.lit(False)), tag)
    if kind == "exact":
        return F.when(seen.text(name) == str(cfg.get("value", "")), tag)
    if kind == "in_list":
        return F.when(seen.lower(name).isin(*[str(v).lower() for v in cfg.get("values", [])] or [""]), tag)
    if kind != "computed":
        return F.lit(None).cast("string")
    algorithm = cfg.get("algorithm", "")
    if algorithm == "panoramic":
        return F.when(F.try_divide(seen.number("exif_width"), seen.number("exif_height")) >= float(cfg.get("min_ratio", 2.0)), tag)
    if algorithm == "decade":
        return F.when(seen.exact("file_date", least), seen.decade())
    if algorithm == "easter" or algorithm in _NTH:
        return F.when(seen.feast(algorithm) & seen.exact("file_date", least), tag)
    return F.lit(None).cast("string")


def apply_rules(rows: DataFrame, key: str, fields: str, rules: list[dict]) -> DataFrame:
    """(key, tag, category) of all rules that fire on the map column ``fields``; each once per key.

    What rules look at is worked out once a row, however many of them share it; the rules only compare.
    """
    seen = _Seen(fields)
    fired = [F.struct(compile_rule(r, seen).alias("tag"), F.lit(r.get("category", "")).alias("category")) for r in rules]
    hits = F.filter(F.array(*fired), lambda r: r["tag"].isNotNull())
    return seen.added(rows, key).select(key, F.explode(F.array_distinct(hits)).alias("r")).select(key, "r.tag", "r.category")


def _rule(kind: str, tag: str, field: str | None, category: str, **cfg) -> dict:
    minimum = cfg.pop("minimum", None)
    return {"match_type": kind, "result_tag": tag, "field_name": field, "category": category, "match_config": cfg, "minimum_precision": minimum}


# Tag, field, lowest and highest value of the technical ranges.
RANGES = (
    ("Square", "aspect_ratio", 0.9, 1.1), ("Widescreen", "aspect_ratio", 1.77, None),
    ("ultra_wide", "focal_length_35mm", None, 24.0), ("wide_angle", "focal_length_35mm", 24.0, 50.0), ("standard", "focal_length_35mm", 50.0, 70.0),
    ("telephoto", "focal_length_35mm", 70.0, 200.0), ("super_telephoto", "focal_length_35mm", 200.0, None),
    ("very_wide_aperture", "aperture", None, 1.8), ("wide_aperture", "aperture", None, 2.8), ("medium_aperture", "aperture", 2.8, 5.6),
    ("narrow_aperture", "aperture", 5.6, 11.0), ("very_narrow_aperture", "aperture", 11.0, None),
    ("long_exposure", "shutter_speed", 1.0, None), ("slow_shutter", "shutter_speed", 0.033, 1.0), ("high_speed", "shutter_speed", None, 0.001),
    ("low_iso", "iso", None, 100.0), ("standard_iso", "iso", 100.0, 800.0), ("high_iso", "iso", 800.0, 3200.0), ("very_high_iso", "iso", 3200.0, None),
    ("low_key", "exposure", None, 0.20), ("standard_exposure", "exposure", 0.20, 0.70), ("high_key", "exposure", 0.70, None),
    ("blown_highlights", "highlights", 0.15, None), ("crushed_shadows", "shadows", 0.15, None),
    ("flat_lighting", "luminance_std_dev", None, 0.08), ("moderate_contrast", "luminance_std_dev", 0.08, 0.22), ("high_contrast", "luminance_std_dev", 0.22, None),
    ("black_and_white", "saturation_mean", None, 0.05), ("muted", "saturation_mean", 0.05, 0.25), ("standard_saturation", "saturation_mean", 0.25, 0.50), ("vibrant", "saturation_mean", 0.50, None),
    ("silhouette", "shadows", 0.60, None), ("warm_tones", "dominant_hue", 20.0, 70.0), ("green_tones", "dominant_hue", 75.0, 165.0), ("cool_tones", "dominant_hue", 180.0, 270.0),
)
# File formats by tag.
FORMATS = {
    "raw_file": "raw arw cr2 cr3 nef orf raf rw2 dng pef srw".split(), "heic": "heic heif".split(),
    "video": "mp4 mov avi mkv m4v mts m2ts wmv flv webm 3gp".split(), "tiff": "tif tiff".split(),
}
# Seasons of the northern hemisphere by month.
SEASON_MONTHS = {"Spring": [3, 4, 5], "Summer": [6, 7, 8], "Autumn": [9, 10, 11], "Winter": [12, 1, 2]}


def standard_rules() -> list[dict]:
    """The 75 rules that hold unless others are given."""
    out = [_rule("month_day", tag, "file_date", "calendar", month=m, day=d, minimum="full") for tag, (m, d) in FEASTS.items()]
    out += [_rule("month_range", tag, "file_date", "calendar", months=ms, minimum="month") for tag, ms in SEASON_MONTHS.items()]
    computed = {"Easter": "easter", "Canadian Thanksgiving": "thanksgiving_ca", "US Thanksgiving": "thanksgiving_us", "Mother's Day": "mothers_day", "Father's Day": "fathers_day"}
    out += [_rule("computed", tag, None, "calendar", algorithm=a, minimum="full") for tag, a in computed.items()]
    out.append(_rule("computed", "Decade", None, "calendar", algorithm="decade", minimum="year"))
    out += [_rule("range", tag, "hour_of_day", "temporal", min=lo, max=hi) for tag, lo, hi in DAY_BANDS]
    out += [_rule("comparison", tag, None, "technical", field_a="exif_width", op=op, field_b="exif_height") for tag, op in (("Landscape", ">"), ("Portrait", "<"))]
    out.append(_rule("computed", "Panoramic", None, "technical", algorithm="panoramic", min_ratio=2.0))
    out += [_rule("range", tag, field, "technical", min=lo, max=hi) for tag, field, lo, hi in RANGES]
    out += [_rule("exact", tag, "flash_fired", "technical", value=v) for tag, v in (("flash_fired", "1"), ("no_flash", "0"))]
    out += [_rule("in_list", tag, "file_format", "technical", values=v) for tag, v in FORMATS.items()]
    out.append(_rule("exact", "geotagged", "gps_present", "technical", value="true"))
    return out


def normalised_name(filename: Column, rules: list[dict], stopwords: list[str] = (), rejected: list[str] = (), substitutes: list[tuple[str, str]] = ()) -> Column:
    """struct(name, captured) of a file name: per token the first rule that matches decides.

    A rule has pattern, is_regex, action (reject, ignore, replace, capture),
    replace_with, extract_as, format_str and keep_token. Regexes match at a token's
    start. A later token's capture replaces an earlier one's. Stopwords and rejected
    tokens go; substitutes are applied to the joined name in order.
    """
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")

    def decide(t: Column) -> Column:
        out, field, kept = t, F.lit(None).cast("string"), F.lit(True)
        value = F.lit(None).cast("string")
        for r in reversed(rules):
            regex = "^(?:" + r["pattern"] + ")"
            hit = t.rlike(regex) if r.get("is_regex") else t == r["pattern"]
            action = r["action"]
            new = template(r.get("format_str") or r.get("replace_with"), t, regex) if r.get("is_regex") else F.lit(r.get("replace_with")) if r.get("replace_with") else t
            out = F.when(hit, new if action == "replace" else t).otherwise(out)
            keep = action == "replace" or (action == "capture" and bool(r.get("keep_token", True)))
            kept = F.when(hit, F.lit(keep)).otherwise(kept)
            field = F.when(hit, F.lit(r.get("extract_as") if action == "capture" else None).cast("string")).otherwise(field)
            value = F.when(hit, new if action == "capture" else F.lit(None).cast("string")).otherwise(value)
        gone = t.isin(*rejected) if rejected else F.lit(False)
        stop = out.isin(*stopwords) if stopwords else F.lit(False)
        return F.struct(F.when(~gone & kept & ~stop, out).alias("out"), F.when(~gone, field).alias("field"), value.alias("value"))

    steps = F.transform(path_tokens(stem), decide)
    name = F.array_join(F.filter(F.transform(steps, lambda s: s["out"]), lambda x: x.isNotNull()), " ")
    for pattern, replacement in substitutes:
        name = F.regexp_replace(name, pattern, replacement)
    found = F.filter(steps, lambda s: s["field"].isNotNull())
    # of equal fields the last one counts
    later = lambda s, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda o: o["field"] == s["field"])
    last = F.filter(found, lambda s, i: ~later(s, i))
    captured = F.map_from_arrays(F.transform(last, lambda s: s["field"]), F.transform(last, lambda s: s["value"]))
    return F.struct(F.trim(name).alias("name"), captured.alias("captured"))


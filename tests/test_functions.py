import calendar
import datetime

from pyspark.sql import functions as F

from mosaicry.functions.dates import date_precision, easter, nth_weekday, precise_enough, temporal_fields
from mosaicry.functions.geo import box_to_pixels, haversine_m, masked, parse_angle
from mosaicry.functions.text import clean_term, folder, name_parts, normal_name, path_tokens, template, token_class, token_proposal, word_windows
from mosaicry.functions.vectors import cosine, hamming_hex


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {t}" for k, t in zip(values, [{str: "string", int: "int", float: "double", list: "array<double>", type(None): "string"}[type(v)] for v in values.values()])) or "x int")
    return df.select(col.alias("r")).first()["r"]


def test_easter_and_weekdays(spark):
    known = {1961: (4, 2), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2019: (4, 21), 2024: (3, 31), 2038: (4, 25), 2049: (4, 18), 2076: (4, 19), 1954: (4, 18)}
    m, d = easter(F.col("y"))
    got = {r["y"]: (r["m"], r["d"]) for r in spark.createDataFrame([(y,) for y in known], "y int").select("y", m.alias("m"), d.alias("d")).collect()}
    assert got == known
    r = spark.createDataFrame([(y,) for y in range(1990, 2030)], "y int").select("y", nth_weekday(F.col("y"), 11, 3, 4).alias("d")).collect()
    assert all(x["d"] == [w[3] for w in calendar.monthcalendar(x["y"], 11) if w[3]][3] for x in r)


def test_temporal_fields(spark):
    cases = [("2023:12:25 07:10:00", None), (None, "2021-04-04"), ("bad", "1999-02-30"), (None, "1984"), ("2020-01-01T24:00", None), (None, None), ("2022-05-08", "2020-01-01")]
    df = spark.createDataFrame(cases, "a string, b string").select(temporal_fields(F.col("a"), F.col("b")).alias("t"))
    got = [tuple(r["t"]) for r in df.collect()]
    assert got[0] == (2023, "2020s", "December", "Winter", "Monday", "Christmas Day", "golden_hour_morning")
    assert got[1] == (2021, "2020s", "April", "Spring", "Sunday", "Easter", None)
    assert got[2] == (1999, "1990s", "February", "Winter", None, None, None)
    assert got[3] == (None,) * 7 == got[5]
    assert got[4][5:] == ("New Year's Day", None) and got[6][5:] == ("Mother's Day", None)


def test_precision(spark):
    df = spark.createDataFrame([("1984",), ("1980s",), ("1984-05",), ("1984-05-03",), ("",), (None,), ("spring",)], "d string")
    got = [tuple(r) for r in df.select(date_precision(F.col("d")), precise_enough(F.col("d"), "month")).collect()]
    assert got == [("year", False), ("decade", False), ("month", True), ("full", True), ("full", True), ("full", True), ("year", False)]


def test_tokens(spark):
    df = spark.createDataFrame([("a/IMG_20230512-holidayAtSea.JPG",), ("XMLFile  x_x",), ("",), (None,)], "p string")
    got = [r[0] for r in df.select(path_tokens(F.col("p"))).collect()]
    assert got == [["a", "img", "20230512", "holiday", "at", "sea", "jpg"], ["xml", "file", "x"], [], None]
    want = {"20230512": ("8digit_numeric", "date"), "20231399": ("8digit_numeric", "unclassified"), "230512": ("6digit_numeric", "date"), "125960": ("6digit_numeric", "time"), "995960": ("6digit_numeric", "unclassified"), "0042": ("sequential", "sequential"), "holiday": ("word", "word"), "at-sea": ("word", "unclassified"), "AB-12": ("route_code", "code"), "holidaySea": ("camelcase", "compound")}
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", token_class(F.col("t")).alias("c"), token_proposal(token_class(F.col("t"))["semantic_type"]).alias("p"))
    rows = {r["t"]: r for r in df.collect()}
    assert {t: tuple(r["c"]) for t, r in rows.items()} == want
    assert tuple(rows["230512"]["p"]) == ("capture", "file_date") and tuple(rows["0042"]["p"]) == ("ignore", "") and tuple(rows["holiday"]["p"]) == ("none", "")


def test_text_helpers(spark):
    assert one(spark, clean_term(F.col("t")), t="--Old mill!?") == "Old mill" and one(spark, clean_term(F.col("t")), t="...") is None
    assert one(spark, normal_name(F.col("t")), t="St. Mary's   Pier ") == "st marys pier"
    assert one(spark, template("{1:0:2}/{2}", F.col("t"), r"^(\d{4})(\d{2})"), t="198405") == "19/05"
    assert one(spark, template(None, F.col("t"), r"^\d+"), t="198405x") == "198405"
    assert one(spark, word_windows(F.col("t"), 3, 1), t="a b c d e f") == ["a b c", "c d e", "e f"]
    assert one(spark, word_windows(F.col("t"), 3, 1), t="  ") == [] and one(spark, word_windows(F.col("t"), 5, 1), t="a b") == ["a b"]
    assert tuple(one(spark, name_parts(F.col("t")), t="Ann  Mary Jo Lee")) == ("Ann", "Mary Jo", "Lee") and tuple(one(spark, name_parts(F.col("t")), t="Ann")) == ("Ann", None, None)
    assert one(spark, folder(F.col("t")), t=r"c:\x\y.jpg") == "c:/x"


def test_geo(spark):
    assert 85_000 < one(spark, haversine_m(F.lit(49.2827), F.lit(-123.1207), F.lit(48.4284), F.lit(-123.3656)), x=1) < 110_000
    assert one(spark, haversine_m(F.lit(1.0), F.lit(1.0), F.lit(1.0003), F.lit(1.0)), x=1) < 50
    assert one(spark, parse_angle(F.col("t")), t="""48 deg 51' 29.60" S""") == -(48 + 51 / 60 + 29.6 / 3600)
    assert one(spark, parse_angle(F.col("t")), t=" -12.5 ") == -12.5 and one(spark, parse_angle(F.col("t")), t="north") is None
    assert one(spark, masked(F.lit(12.3456), F.lit("coarsen"), F.lit(2)), x=1) == 12.35 and one(spark, masked(F.lit(12.3), F.lit("strip"), F.lit(2)), x=1) is None
    assert tuple(one(spark, box_to_pixels(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4), F.lit(100), F.lit(50)), x=1)) == (40.0, 15.0, 60.0, 35.0)


def test_vectors(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == 1 / 2**0.5
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0 and one(spark, cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) is None
    assert one(spark, hamming_hex(F.lit("ffff000000000000"), F.lit("FFFE000000000003")), x=1) == 3
    assert datetime.date(2000, 1, 1)

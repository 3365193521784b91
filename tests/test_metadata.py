import json

import pytest
from pyspark.sql import functions as F

from mosaicry.operators import metadata as m
from mosaicry.operators.rules import apply_rules, standard_rules
from mosaicry.operators.scope import behind, marked
from mosaicry.sources import bundles as b


def test_fields_and_keywords_of_documents(spark):
    docs = [(1, json.dumps({"A": None, "B": "late", "K": ["x", " x ", "", "y"]})), (2, json.dumps({"A": 3, "K": "one"})), (3, "broken"), (4, None), (5, "{}"), (6, json.dumps({"A": "", "K": None, "L": ["never"]}))]
    df = spark.createDataFrame(docs, "id long, doc string")
    fm = [{"canonical": "f", "tag": "B", "priority": 2}, {"canonical": "f", "tag": "A", "priority": 1}, {"canonical": "k", "tag": "L", "priority": 2, "type": "keyword_list"}, {"canonical": "k", "tag": "K", "priority": 1, "type": "keyword_list"}]
    assert {tuple(r) for r in m.extracted_fields(df, "id", "doc", fm).collect()} == {(1, "f", "B", "late"), (2, "f", "A", "3"), (6, "f", "A", "")}
    assert {tuple(r) for r in m.extracted_keywords(df, "id", "doc", fm).collect()} == {(1, "k", "x"), (1, "k", "y"), (2, "k", "one")}
    assert {tuple(r) for r in m.unmapped_tags(df, "doc", ["A", "K", "Z"], ["K"]).collect()} == {("A", 3)}


def test_face_regions_of_parallel_arrays(spark):
    docs = [
        (1, {"RegionName": ["Ann", "", "Dog", "Bo"], "RegionType": ["Face", "Face", "Pet"], "RegionAreaX": [0.1, 0.2, 0.3, 0.4], "RegionAreaY": [0.1, 0.2, 0.3, 0.4], "RegionAreaW": [0.1, 0.2, 0.3, 0.4], "RegionAreaH": [0.1, 0.2, 0.3, 0.4]}),
        (2, {"RegionName": "Cy", "RegionType": "face", "RegionAreaX": 0.5, "RegionAreaY": 0.5, "RegionAreaW": 0.5, "RegionAreaH": 0.5}),
        (3, {"RegionName": ["Di"], "RegionAreaUnit": "pixel", "RegionAreaX": [1], "RegionAreaY": [1], "RegionAreaW": [1], "RegionAreaH": [1]}),
        (4, {"RegionName": ["Ed", "Flo"], "RegionAreaX": [0.1], "RegionAreaY": [0.1], "RegionAreaW": ["wide"], "RegionAreaH": [0.1]}),
        (5, {"ACDSeeRegionName": ["Gus", "Hal", "Ida"], "ACDSeeRegionDLYAreaX": [None, 0.7], "ACDSeeRegionDLYAreaY": [None, 0.7], "ACDSeeRegionDLYAreaW": [None, 0.7], "ACDSeeRegionDLYAreaH": [None, 0.7],
             "ACDSeeRegionALGAreaX": [0.6, 0.6], "ACDSeeRegionALGAreaY": [0.6, 0.6], "ACDSeeRegionALGAreaW": [0.6, 0.6], "ACDSeeRegionALGAreaH": [0.6, 0.6]}),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in docs] + [(6, None), (7, "no")], "id long, doc string")
    got = {(r["id"], r["source"], r["place"], r["name"], r["cx"]) for r in m.face_regions(df, "id", "doc", m.REGION_TAGS).collect()}
    assert got == {(1, "mwg-rs", 0, "Ann", 0.1), (1, "mwg-rs", 3, "Bo", 0.4), (2, "mwg-rs", 0, "Cy", 0.5), (5, "acdsee", 0, "Gus", 0.6), (5, "acdsee", 1, "Hal", 0.7)}


def test_inputs_of_rules(spark):
    rows = [(1, {"exif_width": "4000"}, {"exif_width": "1", "exif_height": "1000", "flash": "25.0", "exif_gps_lat": "5", "exif_date_taken": "2023-12-25T14:30:00"}, ".JPG"), (2, None, {"flash": "x", "exif_date_taken": "2023", "exif_width": "0"}, ""), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id long, c map<string,string>, m map<string,string>, ext string")
    f = df.select("id", m.rule_fields(F.col("c"), F.col("m"), F.col("ext"), {"shadows": F.lit(0.2), "exposure": F.lit(None)}).alias("f"))
    got = {r["id"]: r["f"] for r in f.collect()}
    assert got[1] == {"exif_width": "4000", "exif_height": "1000", "flash": "25.0", "exif_gps_lat": "5", "exif_date_taken": "2023-12-25T14:30:00", "file_format": "jpg", "gps_present": "true", "hour_of_day": "14", "flash_fired": "1", "aspect_ratio": "4.0", "shadows": "0.2"}
    assert got[2] == {"flash": "x", "exif_date_taken": "2023", "exif_width": "0", "shadows": "0.2"} and got[3] == {"shadows": "0.2"}
    tags = {(r["id"], r["tag"]) for r in apply_rules(f, "id", "f", standard_rules()).collect()}
    assert {(1, "flash_fired"), (1, "Panoramic"), (1, "Landscape"), (1, "geotagged"), (3, "crushed_shadows")} <= tags


def test_keywords_and_synonyms(spark):
    v = spark.createDataFrame([("a", ["b", "c"], True), ("d", ["e"], None), ("f", ["g"], False), ("z", ["b"], None), ("n", None, True)], "term string, synonyms array<string>, write_synonyms boolean")
    t = spark.createDataFrame([(1, "a"), (1, "d"), (2, "f"), (2, None), (3, "n"), (1, "a")], "k long, tag string")
    keys = lambda s: {tuple(r) for r in m.resolved_keywords(t, "k", "tag", v, s).collect()}
    assert keys(False) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "f"), (3, "n")} and keys(True) == keys(False) | {(1, "e")}
    assert {tuple(r) for r in m.synonym_map(v).collect()} == {("b", "z"), ("c", "a"), ("e", "d"), ("g", "f")}
    w = m.with_synonyms(v, spark.createDataFrame([("a", "x"), ("a", "b"), ("n", "q"), ("none", "y")], "term string, synonym string"))
    assert {r["term"]: r["synonyms"] for r in w.collect()} == {"a": ["b", "c", "x"], "d": ["e"], "f": ["g"], "z": ["b"], "n": ["q"]}
    df = spark.createDataFrame([(["a"], ["t"]), (["t"], ["t"]), (None, ["t"]), (["a"], None)], "tags array<string>, new array<string>")
    assert [r[0] for r in df.select(m.with_term(F.col("tags"), F.col("new"), "t")).collect()] == [["a", "t"], None, ["t"], None]
    r = spark.createDataFrame([('{"tags": ["a"], "refined_description": "d", "new_terms": null}',), ("oops",), (None,)], "r string").select(m.parsed_reply(F.col("r")).alias("p"))
    assert [tuple(x["p"]) for x in r.collect()] == [(["a"], "d", []), ([], "", []), ([], "", [])]


def test_events_texts_and_patterns(spark):
    rows = [("2020-05-04", "birth", "1990-05-04"), ("2020-05-04", "birth", "1990-05"), ("2020-05-04", "birth", "1990-05-05"), ("1990-05-04", "birth", "1990-05-04"), ("2020-05-04", "marriage", "2000-05-04"), ("2020-05-04", "marriage", "2000-05"), ("2020-05", "death", "2000-05-04"), ("2020-05-04", "death", "2000-05-04"), (None, "birth", "1990-05-04")]
    df = spark.createDataFrame(rows, "f string, e string, d string")
    got = [r[0] for r in df.select(m.life_event_tag(F.col("f"), F.lit("Ann"), F.col("e"), F.col("d"))).collect()]
    assert got == ["Ann's 30th Birthday", "Ann's 30th Birthday", None, "Ann's Birthday", "Ann — 20th Anniversary", None, None, "In memory of Ann", None]
    one = spark.createDataFrame([("a  b $1",)], "t string")
    assert one.select(m.substituted(F.col("t"), [(r"\s+", " "), (r"(a) (b)", r"\2-\1"), ("b", "$")])).first()[0] == "$-a $1"
    t = spark.createDataFrame([("A+",), ("a+b",), ("xay",), (None,)], "t string").select(m.matches_any(F.col("t"), [("a+", False), ("^x", True)]))
    assert [r[0] for r in t.collect()] == [True, False, True, None]
    assert one.select(m.prompt({"L": F.col("t"), "M": F.lit(" ")}, "base", "f")).first()[0] == "L: a  b $1\nbase\nFocus on: f"


def test_bundles_regions_and_zones(spark, tmp_path):
    (tmp_path / "_registry.csv").write_text("table_name,display_name\nboats,Boats\nnone,None\n")
    (tmp_path / "boats.csv").write_text("﻿Boat Name,Alias\nErna,E|Er\n-,x\n")
    got = b.read_bundle(spark, str(tmp_path))
    assert set(got) == {"_registry", "boats"} and got["boats"].columns == ["boat_name", "alias"] and got["boats"].count() == 1
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "Feature", "properties": {"name": "Sq"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}))
    (tmp_path / "c.kml").write_text("<kml><Placemark><name>K</name><coordinates>0,0 1,0 1,1</coordinates></Placemark></kml>")
    assert {(r["name"], r["level"]) for r in b.read_regions(spark, str(tmp_path)).collect()} == {("Sq", "custom"), ("K", "custom")}
    (tmp_path / "empty").mkdir()
    assert b.read_regions(spark, str(tmp_path / "empty")).count() == 0
    z = b.read_zones(spark, [{"name": "f", "file": "a.geojson", "mode": "coarsen", "decimal_places": 1}, {"name": "c", "center": [50.0, 8.0], "radius_m": 500}, {"name": "bad"}, {"name": "gone", "file": "x.kml"}], str(tmp_path))
    assert {(r["name"], r["mode"], r["decimal_places"]) for r in z.collect()} == {("f", "coarsen", 1), ("c", "strip", 2)}
    pytest.importorskip("yaml")
    (tmp_path / "z.yaml").write_text("zones:\n  - name: y\n    center: [1, 2]\n    radius_m: 10\n")
    assert [r["name"] for r in b.read_zone_file(spark, str(tmp_path / "z.yaml")).collect()] == ["y"]
    shapes = spark.createDataFrame([(1, [[[(0.0, 0.0)]]])], f"record int, polygon {b.POLYGON}")
    row = b.named_regions(shapes, spark.createDataFrame([(1, " ", "Norland", "-99", "NOR")], "record int, NAME_LONG string, ADMIN string, ISO_A2 string, ADM0_A3 string")).first()
    assert (row["country"], row["country_code"], row["state"]) == ("Norland", "NOR", None)


def test_aliases_and_versions(spark):
    t = spark.createDataFrame([("Mill", "M| Old Mill ", None), ("Quay", "", ""), ("", "x", ""), ("Pier", None, "Pier|P")], "place string, Alias string, aka string")
    assert {r["canonical"]: r["terms"] for r in b.alias_groups(t, "place").collect()} == {"Mill": ["Mill", "M", "Old Mill"], "Pier": ["Pier", "P"]}
    assert b.alias_groups(t.select("place"), "place").count() == 0
    f = spark.createDataFrame([(1, None), (2, 3), (3, 5)], "id long, version int")
    assert {r["id"] for r in behind(f, "version", 5).collect()} == {1, 2} and behind(f, "version", None).count() == 0
    assert behind(marked(f, spark.createDataFrame([(1,), (9,)], "id long"), "version", 5), "version", 5).first()["id"] == 2


def test_registers_of_sources(spark):
    s = spark.createDataFrame([(1, "/a", None, None, None)], "id long, path string, removed_at timestamp, last_ingested_at timestamp, file_count_ingested long")
    t = b.added_source(b.added_source(s, "/b"), "/b")
    assert {(r["id"], r["path"]) for r in t.collect()} == {(1, "/a"), (2, "/b")}
    t = b.stamped_source(t, 2, 7)
    assert {r["id"]: r["file_count_ingested"] for r in t.collect()} == {1: None, 2: 7}
    files, facts = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, source_id long"), spark.createDataFrame([(10, "x"), (11, "y")], "file_id long, v string")
    t2, f2, tabs = b.without_source(t, files, {"v": facts}, 1, cascade=True)
    assert {r["id"] for r in t2.filter("removed_at IS NULL").collect()} == {2} and {r["id"] for r in f2.collect()} == {11, 12} and [r["v"] for r in tabs["v"].collect()] == ["y"]
    assert {r["path"] for r in b.changed_source(b.changed_source(t2, 1, path="/no"), 2, path="/c").collect()} == {"/a", "/c"}
    old, new = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int"), spark.createDataFrame([("a", None), ("b", 2), ("b", 2), (None, 1)], "k string, v int")
    assert sorted(map(str, (tuple(r) for r in b.insert_missing(old, new, ["k", "v"]).collect()))) == sorted(map(str, [("a", None), ("b", 1), ("b", 2), (None, 1)]))
    reg, add = spark.createDataFrame([("Old Harbour Light",)], "n string"), spark.createDataFrame([("Old Harbour Lights",), ("Mill",)], "n string")
    with pytest.raises(ValueError, match="Old Harbour"):
        b.new_locations(reg, add, "n")
    assert b.new_locations(reg, add, "n", force=True).count() == 2 and b.new_locations(reg, add.filter("n = 'Mill'"), "n").count() == 1
    assert tuple(b.clusters_as_places(spark.createDataFrame([("c", 1.5, 2.5)], "label string, lat double, lon double"), 0.3).first()) == ("c", "1.5", "2.5", "300.0")


def test_rule_fields_and_what_rules_see_are_worked_out_once(spark):
    df = spark.createDataFrame([(1, "300", "2020-07-01")], "id long, w string, d string")
    captured = F.create_map(F.lit("exif_width"), F.concat("w", F.lit("00")), F.lit("exif_height"), F.lit("100"), F.lit("file_date"), F.col("d"))
    f = df.select("id", m.rule_fields(captured, F.create_map(F.lit("iso"), F.lit("9")), F.lit(".jpg")).alias("f"))
    assert f._jdf.queryExecution().optimizedPlan().toString().count("concat(w") == 1
    t = apply_rules(f, "id", "f", standard_rules())
    assert {r["tag"] for r in t.collect()} >= {"Canada Day", "Summer", "2020s", "Landscape", "Panoramic", "low_iso"}
    assert t._jdf.queryExecution().optimizedPlan().toString().count("element_at(f") <= 40

import datetime
import json

from mosaicry.operators.spatial import containing_polygons
from mosaicry.sources.registers import circle, life_events, name_forms, read_geojson, read_kml, read_register, write_csv
from mosaicry.sources.scan import SourceFilter, changed, contents, file_type, scan
from mosaicry.streaming.events import read_stream, run_available, sessions, window_counts


def test_scan_filters_and_changes(spark, tmp_path):
    for p in ("a/x1.jpg", "a/skip/x2.jpg", "b/y.MP4", "b/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    f = scan(spark, str(tmp_path))
    assert {(r["filename"], r["file_type"]) for r in f.collect()} == {("x1.jpg", "images"), ("x2.jpg", "images"), ("y.MP4", "video"), ("note.txt", None)}
    assert {r["filename"] for r in SourceFilter(exclude=("sk*",), glob="*.jpg").apply(f).collect()} == {"x1.jpg"}
    assert SourceFilter(count_limit=2).apply(f).count() == 2 and SourceFilter(modified_after="2999-01-01").apply(f).count() == 0
    assert changed(f, f).count() == 0
    known = f.filter("filename <> 'y.MP4'")
    assert [r["filename"] for r in changed(f, known).collect()] == ["y.MP4"]
    import hashlib

    assert {r["sha256"] for r in contents(spark, str(tmp_path)).collect()} >= {hashlib.sha256(b"a/x1.jpg").hexdigest()}
    assert file_type is not None


def test_registers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Name ID,Nick Names,Birth date,Death,SpouseID\nn1,Bob|Rob,1950-01-02,-,n2\nn2,,1951,,zz\n-,x,,,\n")
    r = read_register(spark, str(tmp_path / "p.csv"))
    assert r.columns == ["name_id", "nick_names", "birth_date", "death", "spouseid"] and r.count() == 2
    assert {tuple(x) for x in name_forms(r, "name_id", ["nick_names"]).collect()} == {("n1", "nick_names", "Bob"), ("n1", "nick_names", "Rob")}
    got = {tuple(x[c] for c in ("name_id", "event", "date", "spouse_key")) for x in life_events(r, "name_id", {"birth_date": "birth", "death": "death"}, "spouseid").collect()}
    assert got == {("n1", "birth", "1950-01-02", "n2"), ("n2", "birth", "1951", None)}
    write_csv(name_forms(r, "name_id", ["nick_names"]), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_polygon_files(spark, tmp_path):
    sq = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "sq"}, "geometry": {"type": "Polygon", "coordinates": [sq]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[sq], [[[x + 5, y] for x, y in sq]]]}}, {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1, 1]}}]}
    (tmp_path / "zone.geojson").write_text(json.dumps(doc))
    (tmp_path / "one.kml").write_text("<kml><Placemark><name>tri</name><coordinates>0,0,0 2,0,0 0,2,0</coordinates><coordinates>1,1 2,2</coordinates></Placemark></kml>")
    g = {r["name"]: len(r["polygon"]) for r in read_geojson(spark, str(tmp_path / "zone.geojson")).collect()}
    assert g == {"sq": 1, "zone": 2}
    k = read_kml(spark, str(tmp_path / "one.kml"))
    assert [(r["name"], len(r["polygon"][0][0])) for r in k.collect()] == [("tri", 3)]
    z = spark.createDataFrame([(1, circle(10.0, 10.0, 1000.0))], "pid long, polygon array<array<array<struct<lon:double,lat:double>>>>")
    pts = spark.createDataFrame([(1, 10.001, 10.0), (2, 10.02, 10.0)], "id long, lat double, lon double")
    assert [r["id"] for r in containing_polygons(pts, "id", "lat", "lon", z, "pid").collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, kind string, value double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    s = window_counts(read_stream(spark, str(tmp_path / "in"), df.schema), "ts", "kind", "value", late="100 hours")
    for _ in range(2):
        run_available(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    # windows stay open for late events, so nothing is final yet; a batch shows all
    assert spark.read.schema(s.schema).parquet(str(tmp_path / "out")).count() == 0
    assert window_counts(df, "ts", "kind", "value").agg({"n": "sum"}).first()[0] == 100
    assert sessions(df, "ts", "user_id", "10 minutes").count() == 100 and sessions(df, "ts", "user_id", "22 minutes").count() == 3


def test_archives(spark, tmp_path):
    import struct
    import zipfile

    from mosaicry.sources.archives import read_kmz, read_shapes

    with zipfile.ZipFile(tmp_path / "z.kmz", "w") as z:
        z.writestr("doc.kml", "<kml><Placemark><coordinates>0,0 2,0 0,2</coordinates></Placemark></kml>")
    (tmp_path / "bad.kmz").write_bytes(b"no archive")
    assert [(r["name"], len(r["polygon"][0][0])) for r in read_kmz(spark, str(tmp_path / "*.kmz")).collect()] == [("z", 3)]
    pts = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in pts)
    null = struct.pack("<i", 0)
    (tmp_path / "s.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body + struct.pack(">ii", 2, len(null) // 2) + null)
    got = read_shapes(spark, str(tmp_path / "s.shp")).collect()
    assert [(r["name"], r["record"], len(r["polygon"][0][0])) for r in got] == [("s", 1, 4)]

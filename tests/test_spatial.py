import math
import random

from mosaicry.operators import skew, spatial
from mosaicry.operators.spatial import containing_polygons, near_pairs

POINTS = "id long, lat double, lon double, cell string, distance_m int"
POLYS = "pid long, polygon array<array<array<struct<lon:double,lat:double>>>>, lat string"


def haversine(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))


def dense(n, seed=1):
    rnd = random.Random(seed)
    out = [(i, 50 + rnd.random() * 0.01, 8 + rnd.random() * 0.01, None, None) for i in range(n)]
    out += [(1000 + i, 89.9995 + rnd.random() * 0.0005, rnd.uniform(-180, 180), "x", 1) for i in range(20)]
    out += [(2000 + i, 10 + rnd.random() * 1e-3, s * 180 - s * rnd.random() * 1e-3, "x", 1) for i in range(10) for s in (1, -1)][:20]
    return [(i, *r[1:]) for i, r in enumerate(out)]


def test_near_pairs_equal_brute_force_at_pole_and_date_line(spark):
    rows = dense(150)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and haversine(a, b) <= 150}
    df = spark.createDataFrame(rows + rows[:5], POINTS)
    for block in (20_000, 7):
        got = [(r["id_a"], r["id_b"]) for r in near_pairs(df, "id", "lat", "lon", 150.0, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert any(a >= 150 for a, _ in want)


def test_near_pairs_leave_out_unusable_points(spark):
    bad = [(1, None, 1.0, None, None), (2, 0.0, 0.0, None, None), (3, 0.0, 0.0, None, None), (4, 91.0, 0.0, None, None), (5, 1.0, 181.0, None, None), (None, 1.0, 1.0, None, None), (6, float("nan"), 1.0, None, None)]
    assert near_pairs(spark.createDataFrame(bad, POINTS), "id", "lat", "lon", 1e6).count() == 0
    assert near_pairs(spark.createDataFrame([], POINTS), "id", "lat", "lon", 150.0).count() == 0
    same = [(1, 5.0, 5.0, None, None), (2, 5.0, 5.0, None, None), (3, 5.0, 5.0, None, None)]
    assert near_pairs(spark.createDataFrame(same, POINTS), "id", "lat", "lon", 0.0).count() == 3


def ring(*pts):
    return [{"lon": float(x), "lat": float(y)} for x, y in pts]


def test_polygons_with_holes_parts_and_open_rings(spark, monkeypatch):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    hole = ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    far = ring((20, 20), (21, 20), (20.5, 21))
    polys = [(1, [[square, hole], [far]], "n"), (2, None, None), (3, [], None), (4, [[ring((0, 0), (1, 1))]], None), (5, [[ring((-180, -90), (180, -90), (180, 90), (-180, 90))]], None), (None, [[square]], None)]
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-1, 22), rnd.uniform(-1, 22), None, None) for i in range(400)]

    def inside(x, y):
        return (0 <= x < 10 and 0 <= y < 10 and not (4 <= x < 6 and 4 <= y < 6)) or (20 <= y <= 21 and abs(x - 20.5) < (21 - y) / 2)

    got = {(r["id"], r["poly_id"]) for r in containing_polygons(spark.createDataFrame(pts, POINTS), "id", "lat", "lon", spark.createDataFrame(polys, POLYS), "pid").collect()}
    assert got == {(i, 1) for i, y, x, *_ in pts if inside(x, y)} | {(p[0], 5) for p in pts}
    assert containing_polygons(spark.createDataFrame(pts, POINTS), "id", "lat", "lon", spark.createDataFrame([], POLYS), "pid").count() == 0
    # a cover too large to broadcast, with dense cells
    monkeypatch.setattr(spatial, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(skew, "BLOCK", 9)
    wide = containing_polygons(spark.createDataFrame(pts, POINTS), "id", "lat", "lon", spark.createDataFrame(polys, POLYS), "pid")
    assert sorted(map(tuple, wide.collect())) == sorted(got)

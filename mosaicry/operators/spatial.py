"""Points near points, and points in polygons.

Points near points: positions become earth-centred coordinates in metres, so one
cubic grid serves poles and the date line alike. A point lies in one cell and
probes the few cells that its search box touches.

Points in polygons: each polygon gets an adaptive quadtree cover. Cells wholly
inside accept their points by the equi-join alone; cells on the boundary carry
the edges that a ray to the east may cross, and only their points are tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.functions.geo import EARTH_M, haversine_m, quad_cell, usable_point
from mosaicry.operators.skew import BLOCK, salted_join
from mosaicry.scratch import materialize
from mosaicry.tables import BROADCAST_LIMIT

_COVER = "poly_id long, level int, cell long, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def near_pairs(points: DataFrame, id_col: str, lat: str, lon: str, radius_m: float, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, distance_m) of all pairs at most ``radius_m`` apart, id_a < id_b.

    Unusable points (null, out of range, both zero) pair with nobody, repeated ids
    count once, an empty table gives no rows; other columns are ignored, so their
    names cannot clash. A dense cell is cut into parts of ``block`` points.
    """
    if radius_m < 0:
        raise ValueError("radius_m must not be negative")
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon"))).dropDuplicates(["id"])
    size = max(2.0 * radius_m, 2 * EARTH_M / (1 << 20))
    reach = radius_m * (1 + 1e-9) + 1e-6
    la, lo = F.radians("lat"), F.radians("lon")
    axes = [EARTH_M * F.cos(la) * F.cos(lo), EARTH_M * F.cos(la) * F.sin(lo), EARTH_M * F.sin(la)]
    p = p.select("id", "lat", "lon", *[v.alias(n) for n, v in zip("xyz", axes)])
    p = materialize(p, "points")

    def slot(v: Column) -> Column:
        return F.floor(v / size) + F.lit(1 << 20)

    def key(x: Column, y: Column, z: Column) -> Column:
        return x * F.lit(1 << 42) + y * F.lit(1 << 21) + z

    base = p.select(key(*[slot(F.col(n)) for n in "xyz"]).alias("cell"), F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    probe = p.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), *[F.sequence(slot(F.col(n) - reach), slot(F.col(n) + reach)).alias(n) for n in "xyz"])
    for n in "xyz":
        probe = probe.withColumn(n, F.explode(n))
    probe = probe.select(key(F.col("x"), F.col("y"), F.col("z")).alias("cell"), "id_a", "lat_a", "lon_a")
    d = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    j = salted_join(base, probe, "cell", "id_b", block).filter(F.col("id_a") < F.col("id_b")).withColumn("distance_m", d)
    return j.filter(F.col("distance_m") <= radius_m).select("id_a", "id_b", "distance_m")


def _edges(polygon) -> np.ndarray:
    """All edges of all rings as rows x1, y1, x2, y2; open rings are closed."""
    out = []
    for part in polygon if polygon is not None else []:
        for ring in part if part is not None else []:
            pts = [(p["lon"], p["lat"]) for p in (ring if ring is not None else []) if p is not None and p["lon"] is not None and p["lat"] is not None]
            if len(pts) > 2:
                a = np.array(pts, dtype=float)
                out.append(np.hstack([a, np.roll(a, -1, axis=0)]))
    return np.vstack(out) if out else np.zeros((0, 4))


def _even_odd(e: np.ndarray, x: float, y: float) -> bool:
    up = (e[:, 1] > y) != (e[:, 3] > y)
    e = e[up]
    return bool((x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum() % 2)


def _touching(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges meet the closed box; may err to yes by rounding, never to no."""
    eps = 1e-9
    x0, y0, x1, y1 = x0 - eps, y0 - eps, x1 + eps, y1 + eps
    m = (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 1], e[:, 3]) >= y0) & (np.minimum(e[:, 1], e[:, 3]) <= y1)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    side = np.stack([dx * (cy - e[:, 1]) - dy * (cx - e[:, 0]) for cx in (x0, x1) for cy in (y0, y1)])
    tol = 1e-12 * (1 + np.abs(dx) + np.abs(dy))
    return m & ~((side > tol).all(axis=0) | (side < -tol).all(axis=0))


def cover(polygon, depth: int = 5, few: int = 2, max_level: int = 28) -> list[tuple[int, int, bool, np.ndarray]]:
    """(level, cell, inside, edges) cells of one polygon.

    Starts at the level whose cells are about as large as the bounding box and
    divides boundary cells for ``depth`` more levels, or until at most ``few``
    edges cross them.
    """
    e = _edges(polygon)
    if not len(e):
        return []
    lo, hi = e[:, :2].min(axis=0), e[:, :2].max(axis=0)
    w, h = max(hi[0] - lo[0], 1e-7), max(hi[1] - lo[1], 1e-7)
    start = int(np.clip(np.floor(np.log2(min(360 / w, 180 / h))), 0, max_level))
    stop = min(start + depth, max_level)
    n = 1 << start

    def span(a: float, b: float, origin: float, full: float) -> range:
        f = np.clip(np.floor((np.array([a - 1e-9, b + 1e-9]) + origin) / full * n), 0, n - 1).astype(int)
        return range(f[0], f[1] + 1)

    todo = [(start, ix, iy, e) for ix in span(lo[0], hi[0], 180, 360) for iy in span(lo[1], hi[1], 90, 180)]
    out = []
    while todo:
        level, ix, iy, near = todo.pop()
        cw, ch = 360 / (1 << level), 180 / (1 << level)
        x0, y0 = ix * cw - 180, iy * ch - 90
        near = near[_touching(near, x0, y0, x0 + cw, y0 + ch)]
        cell = (level << 58) + (ix << 29) + iy
        if not len(near):
            if _even_odd(e, x0 + cw / 2, y0 + ch / 2):
                out.append((level, cell, True, near))
        elif level >= stop or (len(near) <= few and level > start + 2):
            m = (np.maximum(e[:, 1], e[:, 3]) >= y0 - 1e-9) & (np.minimum(e[:, 1], e[:, 3]) <= y0 + ch + 1e-9) & (np.maximum(e[:, 0], e[:, 2]) >= x0 - 1e-9)
            out.append((level, cell, False, e[m]))
        else:
            todo += [(level + 1, 2 * ix + i, 2 * iy + j, near) for i in (0, 1) for j in (0, 1)]
    return out


def _cover_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edge = pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")])
    schema = pa.schema([("poly_id", pa.int64()), ("level", pa.int32()), ("cell", pa.int64()), ("inside", pa.bool_()), ("edges", pa.list_(edge))])
    for b in batches:
        rows = [
            {"poly_id": r["poly_id"], "level": level, "cell": cell, "inside": inside, "edges": [dict(zip(("x1", "y1", "x2", "y2"), map(float, e))) for e in ed]}
            for r in b.to_pylist()
            for level, cell, inside, ed in cover(r["polygon"])
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def polygon_cover(polygons: DataFrame, id_col: str, polygon: str) -> DataFrame:
    """The cover cells of all polygons as a written table."""
    p = polygons.filter(F.col(id_col).isNotNull() & F.col(polygon).isNotNull()).select(F.col(id_col).cast("long").alias("poly_id"), F.col(polygon).alias("polygon"))
    p = p.dropDuplicates(["poly_id"]).repartition(max(8, p.sparkSession.sparkContext.defaultParallelism), "poly_id")
    return materialize(p.mapInArrow(_cover_batches, _COVER), "cover")


def containing_polygons(points: DataFrame, id_col: str, lat: str, lon: str, polygons: DataFrame, poly_id: str, polygon: str = "polygon") -> DataFrame:
    """(id, poly_id) for every usable point and every polygon that contains it.

    Straight edges in lon/lat, even-odd over all rings of all parts, so holes are
    outside. Polygons that are null, empty or have fewer than three corners contain
    nothing. Unusable points and null ids give no rows; repeated ids count once.
    The cover is broadcast only if its measured size is small; otherwise cells and
    points meet in a shuffle, in which dense cells are cut into parts.
    """
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon"))).dropDuplicates(["id"])
    c = polygon_cover(polygons, poly_id, polygon)
    info = c.agg(F.collect_set("level").alias("levels"), F.count("*").alias("n"), F.sum(F.size("edges")).alias("edges")).first()
    levels = sorted(info["levels"]) or [0]
    fits = info["n"] * 64 + (info["edges"] or 0) * 40 <= BROADCAST_LIMIT
    p = p.withColumn("cell", F.explode(F.array(*[quad_cell(F.col("lat"), F.col("lon"), x) for x in levels])))
    y, x = F.col("lat"), F.col("lon")

    def crosses(s: Column) -> Column:
        at = (s["x2"] - s["x1"]) * (y - s["y1"]) / F.when(s["y2"] != s["y1"], s["y2"] - s["y1"]) + s["x1"]
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < at)

    exact = F.size(F.filter("edges", crosses)) % 2 == 1
    c = c.drop("level")
    both = p.join(F.broadcast(c), "cell") if fits else salted_join(p, c, "cell", "id")
    return both.filter(F.col("inside") | exact).select("id", "poly_id")

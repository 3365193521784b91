"""Distances and grid cells as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def usable_point(lat: Column, lon: Column) -> Column:
    """Both coordinates known, in range, and not the (0, 0) of an unset device."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def quad_cell(lat: Column, lon: Column, level: int) -> Column:
    """Packed id of the quadtree cell of ``level`` (0 to 28) that holds a point."""
    n = 1 << level
    ix = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(n - 1))
    iy = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1))
    return F.lit(level << 58) + ix * F.lit(1 << 29) + iy


def parse_angle(raw: Column) -> Column:
    """Degrees from a decimal number or "48 deg 51' 29.6\" N"; south and west are negative; null if neither."""
    s = F.trim(raw)
    dms = r"""^([0-9.]+)\s*deg\s*([0-9.]+)'\s*([0-9.]+)"?\s*([NSEW]?)\s*$"""
    part = lambda i: F.regexp_extract(s, dms, i).try_cast("double")
    size = part(1) + part(2) / 60 + part(3) / 3600
    return F.coalesce(s.try_cast("double"), F.when(F.regexp_extract(s, dms, 4).isin("S", "W"), -size).otherwise(size))


def masked(value: Column, mode: Column, places: Column) -> Column:
    """A coordinate under a privacy zone: null under strip, rounded half to even under coarsen, as it is elsewhere."""
    power = F.pow(F.lit(10.0), places)
    return F.when(mode == "strip", None).when(mode == "coarsen", F.rint(value * power) / power).otherwise(value)


def box_to_pixels(cx: Column, cy: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """struct(x1, y1, x2, y2) in pixels of a normalised centre and size."""
    return F.struct(((cx - w / 2) * img_w).alias("x1"), ((cy - h / 2) * img_h).alias("y1"), ((cx + w / 2) * img_w).alias("x2"), ((cy + h / 2) * img_h).alias("y2"))

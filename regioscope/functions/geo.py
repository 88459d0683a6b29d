"""Planar geometry as column expressions.

Points are ``(lon, lat)`` doubles.  A polygon is ``rings``:
``array<array<struct<x:double,y:double>>>``, every ring closed (last vertex
equals the first), first ring the shell, further rings holes.  All tests
are higher-order-function expressions, so they run in the JVM without a
Python round trip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_M = 6371008.8

RING_TYPE = T.ArrayType(T.StructType([
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
RINGS_TYPE = T.ArrayType(RING_TYPE)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(lon, lat) -> Column:
    """``st_as_sf(coords)``: a point struct; NULL if a coordinate is NULL."""
    lon, lat = _c(lon).cast("double"), _c(lat).cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(),
                  F.struct(lon.alias("x"), lat.alias("y")))


def _ring_parity(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd crossing parity of a horizontal ray from (px, py)."""
    def step(acc, i):
        a, b = ring[i], ring[i + 1]
        xa, ya, xb, yb = a["x"], a["y"], b["x"], b["y"]
        straddles = (ya > py) != (yb > py)
        x_cross = xa + (xb - xa) * F.try_divide(py - ya, yb - ya)
        crosses = straddles & (px < x_cross)
        return acc != F.coalesce(crosses, F.lit(False))
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(False),
                       step)


def point_in_polygon(rings, px, py) -> Column:
    """Even-odd rule over all rings (holes flip the parity)."""
    px, py = _c(px), _c(py)
    return F.aggregate(_c(rings), F.lit(False),
                       lambda acc, ring: acc != _ring_parity(ring, px, py))


def _bbox_parts(rings):
    xs = F.flatten(F.transform(_c(rings), lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(_c(rings), lambda r: F.transform(r, lambda p: p["y"])))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def bbox(rings) -> Column:
    minx, miny, maxx, maxy = _bbox_parts(rings)
    return F.struct(minx.alias("minx"), miny.alias("miny"),
                    maxx.alias("maxx"), maxy.alias("maxy"))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres; NULL if any coordinate is."""
    r = math.pi / 180.0
    la1, la2 = _c(lat1) * r, _c(lat2) * r
    dla = (_c(lat2) - _c(lat1)) * r
    dlo = (_c(lon2) - _c(lon1)) * r
    h = F.pow(F.sin(dla / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin(dlo / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def local_xy(lon, lat, lon0: float, lat0: float):
    """Equirectangular metres around (lon0, lat0): accurate for the few
    kilometres of a catchment disc."""
    k = EARTH_RADIUS_M * math.pi / 180.0
    return ((_c(lon) - lon0) * (k * math.cos(math.radians(lat0))),
            (_c(lat) - lat0) * k)


# The WGS 84 ellipsoid and the UTM scale and false easting.
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm_xy(lon, lat, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres of the UTM zone (``st_transform``), the
    northing counted from the equator.  The transverse Mercator series in the
    third flattening to the third order: below a millimetre within a zone."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    terms = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = _c(lat) * (math.pi / 180), (_c(lon) - (6 * zone - 183)) * (math.pi / 180)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))  # tangent of the conformal latitude
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(terms, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def min_ring_distance_m(rings, lon0: float, lat0: float) -> Column:
    """Smallest distance (m) from (lon0, lat0) to any polygon edge."""
    k = EARTH_RADIUS_M * math.pi / 180.0
    kx = k * math.cos(math.radians(lat0))

    def seg(ring):
        def d(i):
            a, b = ring[i], ring[i + 1]
            ax, ay = (a["x"] - lon0) * kx, (a["y"] - lat0) * k
            bx, by = (b["x"] - lon0) * kx, (b["y"] - lat0) * k
            dx, dy = bx - ax, by - ay
            t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy),
                           F.lit(0.0))
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
            qx, qy = ax + t * dx, ay + t * dy
            return F.sqrt(qx * qx + qy * qy)
        return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), d))
    return F.array_min(F.transform(_c(rings), seg))


def polygon_meets_disc(rings, lon0: float, lat0: float, radius_m: float) -> Column:
    """Polygon and disc intersect: centre inside, or an edge within r
    (touching counts)."""
    return point_in_polygon(rings, F.lit(lon0), F.lit(lat0)) | \
        (min_ring_distance_m(rings, lon0, lat0) <= radius_m)


def grid_cell(c, cell: float) -> Column:
    return F.floor(_c(c) / cell).cast("long")

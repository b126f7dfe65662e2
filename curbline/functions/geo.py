"""Geodesy, geometry and camera formulas as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, degrees from 0 to below 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def camera_heading(bearing_deg: Column, offset: Column) -> Column:
    return F.pmod(bearing_deg + offset, F.lit(360.0))


# Transverse Mercator by Krueger's series (WGS 84, third flattening to the third order)
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone_of(mean_lon: Column) -> Column:
    return (F.floor((mean_lon + 180) / 6) + 1).cast("int")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def project_metric(lon: Column, lat: Column, zone: Column) -> Column:
    """UTM easting x and northing y (northern hemisphere's origin)."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + _sum([a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA)])
    y = xi + _sum([a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA)])
    return F.struct((500000.0 + _K0 * _R * x).alias("x"), (_K0 * _R * y).alias("y"))


def unproject_wgs84(x: Column, y: Column, zone: Column) -> Column:
    xi, eta = y / (_K0 * _R), (x - 500000.0) / (_K0 * _R)
    xi1 = xi - _sum([b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(_BETA)])
    eta1 = eta - _sum([b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(_BETA)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + _sum([d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA)])
    return F.struct((zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))).alias("lon"), F.degrees(lat).alias("lat"))


def round_compat(x: Column, n: int) -> Column:
    """Half-even rounding, as Python rounds exact ties."""
    return F.bround(x, n)


def box_geometry(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Size, centre and normalised centre form of a corner box."""
    w, h = x2 - x1, y2 - y1
    return F.struct(
        w.alias("w"), h.alias("h"), ((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"),
        ((x1 + w / 2) / width).alias("ncx"), ((y1 + h / 2) / height).alias("ncy"), (w / width).alias("nw"), (h / height).alias("nh"),
    )


def box_corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def pinhole_width_cm(left: Column, right: Column, row: Column, height_px: int, camera_height_m: float) -> Column:
    """Ground width seen between two edges of an image row below the horizon; the focal length cancels."""
    return F.try_divide(camera_height_m * (right - left), row - height_px / 2) * 100


def in_polygon(lat: Column, lon: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd test against (lat, lon) vertices, closed by itself."""
    if len(vertices) < 3:
        raise ValueError("a polygon needs three vertices or more")
    tests = []
    for (a, b), (c, d) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if b != d:  # edges along a meridian never cross the ray
            cross = (F.lit(b) > lon) != (F.lit(d) > lon)
            tests.append(F.when(cross & (lat < (c - a) * (lon - b) / (d - b) + a), 1).otherwise(0))
    return _sum(tests) % 2 == 1

"""Geometry as columns: web-mercator, planar and geodesic length, rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(RADIUS)


def mercator_y(lat: Column) -> Column:
    return F.lit(RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def lon_of(x: Column) -> Column:
    return F.degrees(x / F.lit(RADIUS))


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(math.pi / 2))


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance in the plane of the projection."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def vincenty(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """WGS-84 geodesic length between points in web-mercator, by Vincenty's inverse formula."""
    lon1, lon2 = x1 / RADIUS, x2 / RADIUS
    lat1, lat2 = (2 * np.arctan(np.exp(y / RADIUS)) - np.pi / 2 for y in (y1, y2))
    b = RADIUS * (1 - FLATTENING)
    u1, u2 = np.arctan((1 - FLATTENING) * np.tan(lat1)), np.arctan((1 - FLATTENING) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = lon2 - lon1
    lam = gap.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, cu1 * cu2 * sl / np.where(sin_s == 0, 1, sin_s))
            cos2a = 1 - sin_a**2
            cos_m = np.where(cos2a == 0, 0.0, cos_s - 2 * su1 * su2 / np.where(cos2a == 0, 1, cos2a))
            c = FLATTENING / 16 * cos2a * (4 + FLATTENING * (4 - 3 * cos2a))
            new = gap + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-13
            lam = new
            if done:
                break
    usq = cos2a * (RADIUS**2 - b**2) / b**2
    big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
    big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
    step = big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3))
    return b * big_a * (sigma - big_b * sin_s * (cos_m + step))


@F.pandas_udf(DoubleType())
def geodesic_m(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """Geodesic metres between web-mercator points; apply it to distinct edges."""
    return pd.Series(vincenty(*(c.to_numpy(dtype=float) for c in (x1, y1, x2, y2))))


def ring_terms(ring: Column) -> tuple[Column, Column, Column]:
    """Twice the signed area and the area-weighted centroid sums of a ring ``array<struct<x,y>>``."""
    ahead = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, ahead, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    total = lambda of: F.aggregate(cross, F.lit(0.0), lambda s, t: s + of(t))
    return total(lambda t: t["c"]), total(lambda t: t["c"] * t["sx"]), total(lambda t: t["c"] * t["sy"])


def polygon_area(rings: Column) -> Column:
    """Area of a polygon ``array<ring>``: the shell less the holes."""
    shell = F.abs(ring_terms(F.get(rings, F.lit(0)))[0]) / 2
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return shell - F.aggregate(holes, F.lit(0.0), lambda s, r: s + F.abs(ring_terms(r)[0]) / 2)


def polygon_centroid(rings: Column) -> tuple[Column, Column]:
    """Centroid of a polygon; holes subtract."""

    def weighted(axis: int) -> Column:
        def signed(ring: Column) -> Column:
            terms = ring_terms(ring)
            return F.when(terms[0] < 0, -terms[axis]).otherwise(terms[axis])

        shell = signed(F.get(rings, F.lit(0)))
        holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
        return (shell - F.aggregate(holes, F.lit(0.0), lambda s, r: s + signed(r))) / (6 * polygon_area(rings))

    return weighted(1), weighted(2)


def line_length(points: Column) -> Column:
    """Planar length of ``array<struct<x,y>>``."""
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), ahead, lambda p, q: planar_m(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def projected(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The nearest point of a segment; a degenerate segment is its end."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0)))))
    return x1 + t * dx, y1 + t * dy


def angle_at(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle of two vectors in degrees; 0 if one has no length."""
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / F.nullif(size, F.lit(0.0))))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def deviation_at(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed turn: ``180 - deg`` for a positive ``atan2(cross, dot)``, else ``-180 - deg``."""
    degrees = F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    return F.when(degrees > 0, 180 - degrees).otherwise(-180 - degrees)


def micro(degrees: Column) -> Column:
    """A coordinate as integer micro-degrees, to join on."""
    return F.round(degrees * 1e6).cast("long")

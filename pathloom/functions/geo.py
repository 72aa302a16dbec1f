"""Geodesic and planar geometry as Spark column expressions (all stay inside whole-stage code generation)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom import constants as K

ColumnOrFloat = Column | float


def _c(value: ColumnOrFloat) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def round_even(value: Column, digits: int) -> Column:
    """Half-to-even rounding to a number of decimals."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def haversine_m(lat1: ColumnOrFloat, lon1: ColumnOrFloat, lat2: ColumnOrFloat, lon2: ColumnOrFloat) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = _c(lat1), _c(lon1), _c(lat2), _c(lon2)
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # not least(): it skips nulls, and a missing coordinate must give a missing distance
    return F.asin(F.when(chord > 1, 1.0).otherwise(F.sqrt(chord))) * (2 * K.EARTH_RADIUS_M)


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def signed_turn(previous: Column, current: Column) -> Column:
    """Turn from one bearing to another, wrapped to [-180, 180)."""
    return F.pmod(current - previous + 540.0, F.lit(360.0)) - 180.0


def angle_difference(first: Column, second: Column) -> Column:
    """Unsigned difference of two bearings."""
    return F.abs(signed_turn(second, first))


def turn_modifier(previous: Column, current: Column) -> Column:
    """Turn class of a change of bearing."""
    delta = signed_turn(previous, current)
    size = F.abs(delta)
    rightwards = delta > 0
    return (
        F.when(size < 20, "straight")
        .when(size < 55, F.when(rightwards, "slight_right").otherwise("slight_left"))
        .when(size < 135, F.when(rightwards, "right").otherwise("left"))
        .otherwise("uturn")
    )


def project_to_segment(
    lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column
) -> tuple[Column, Column]:
    """(fraction along the segment clamped to [0,1], distance in metres) in a local equirectangular plane."""
    north = F.lit(K.METRES_PER_DEGREE)
    east = F.cos(F.radians(lat)) * K.METRES_PER_DEGREE
    bx, by = (lon_b - lon_a) * east, (lat_b - lat_a) * north
    px, py = (lon - lon_a) * east, (lat - lat_a) * north
    squared = bx * bx + by * by
    along = F.when(
        squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / squared))
    ).otherwise(0.0)
    dx, dy = px - along * bx, py - along * by
    return along, F.sqrt(dx * dx + dy * dy)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment in a plane."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    along = F.when(
        squared > 0,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / squared)),
    ).otherwise(0.0)
    ex, ey = px - (ax + along * dx), py - (ay + along * dy)
    return F.sqrt(ex * ex + ey * ey)


# -- local metric grid ------------------------------------------------------------------------------------------
_F = 1 / K.GRID_INVERSE_FLATTENING
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)
# Meridian-arc coefficients of the standard ellipsoidal series.
_M0 = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256
_M2 = 3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024
_M4 = 15 * _E2**2 / 256 + 45 * _E2**3 / 1024
_M6 = 35 * _E2**3 / 3072


def _arc(phi: float) -> float:
    return K.GRID_SEMI_MAJOR_M * (
        _M0 * phi - _M2 * math.sin(2 * phi) + _M4 * math.sin(4 * phi) - _M6 * math.sin(6 * phi)
    )


GRID_ARC_ORIGIN = _arc(math.radians(K.GRID_ORIGIN_LAT))


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) metres on the local transverse-Mercator grid. The datum shift is left out: distances do not need it."""
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = F.lit(K.GRID_SEMI_MAJOR_M) / F.sqrt(F.lit(1.0) - sin * sin * _E2)
    t = tan * tan
    c = cos * cos * _EP2
    a = F.radians(lon - K.GRID_ORIGIN_LON) * cos
    arc = (
        phi * _M0 - F.sin(phi * 2) * _M2 + F.sin(phi * 4) * _M4 - F.sin(phi * 6) * _M6
    ) * K.GRID_SEMI_MAJOR_M
    a2 = a * a
    a3 = a2 * a
    x = nu * K.GRID_SCALE * (
        a + (1 - t + c) * a3 / 6 + (5 - t * 18 + t * t + c * 72 - 58 * _EP2) * a3 * a2 / 120
    ) + K.GRID_FALSE_EASTING_M
    y = (
        arc - GRID_ARC_ORIGIN
        + nu * tan * (
            a2 / 2
            + (5 - t + c * 9 + c * c * 4) * a2 * a2 / 24
            + (61 - t * 58 + t * t + c * 600 - 330 * _EP2) * a3 * a3 / 720
        )
    ) * K.GRID_SCALE + K.GRID_FALSE_NORTHING_M
    return x, y


def segment_steps(distance_m: Column, every_m: float = 5.0) -> Column:
    """Number of equal steps so that samples along a segment are at most ``every_m`` apart."""
    return F.greatest(F.lit(1), F.ceil(distance_m / every_m).cast("int"))


def lerp(start: Column, stop: Column, fraction: Column) -> Column:
    return start + (stop - start) * fraction

"""Spherical geometry as Column expressions; angles in degrees, distances in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6_371_000.0


def _num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def normalize(angle: Column) -> Column:
    """The angle's remainder by 360, plus 360 if negative.  A negative angle next to zero gives 360."""
    rest = angle % F.lit(360.0)
    return F.when(rest < 0, rest + 360.0).otherwise(rest)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Forward bearing from the first point to the second; 0 if they are equal."""
    f1, f2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(dl) * F.cos(f2)
    x = F.cos(f1) * F.sin(f2) - F.sin(f1) * F.cos(f2) * F.cos(dl)
    return normalize(F.degrees(F.atan2(y, x)))


def search_angles(current: tuple[Column, Column], previous: tuple[Column, Column], offset: Column | float = 25.0) -> Column:
    """struct(left, right): the direction of travel turned by the offset to either side.  Mind the argument order."""
    heading = bearing(*previous, *current)
    return F.struct(normalize(heading - _num(offset)).alias("left"), normalize(heading + _num(offset)).alias("right"))


def project(lat: Column, lon: Column, distance: Column, angle: Column) -> Column:
    """struct(lat, lon) of the point at a distance and bearing, longitude in [-180, 180)."""
    f1, l1, s, t = F.radians(lat), F.radians(lon), distance / F.lit(EARTH_RADIUS), F.radians(angle)
    f2 = F.asin(F.sin(f1) * F.cos(s) + F.cos(f1) * F.sin(s) * F.cos(t))
    l2 = l1 + F.atan2(F.sin(t) * F.sin(s) * F.cos(f1), F.cos(s) - F.sin(f1) * F.sin(f2))
    turn = (l2 + math.pi) % F.lit(2 * math.pi)
    wrapped = F.when(turn < 0, turn + 2 * math.pi).otherwise(turn) - math.pi
    return F.struct(F.degrees(f2).alias("lat"), F.degrees(wrapped).alias("lon"))


def screen_radians(angle: Column) -> Column:
    """A compass angle as a screen angle: clockwise from the x axis."""
    return F.radians((angle + 270.0) % F.lit(360.0))


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("int")


def to_pixel(cx: Column | float, cy: Column | float, metres: Column, angle: Column, metres_per_pixel: Column | float = 0.265) -> Column:
    """struct(x, y) of the pixel at a distance and compass angle from a centre."""
    reach, a = metres / _num(metres_per_pixel), screen_radians(angle)
    return F.struct(half_up(_num(cx) + reach * F.cos(a)).alias("x"), half_up(_num(cy) + reach * F.sin(a)).alias("y"))


def pixel_metres(dx: Column, dy: Column, metres_per_pixel: Column | float = 0.265) -> Column:
    return F.hypot(dx, dy) * _num(metres_per_pixel)


def mercator_metres_per_pixel(lat: Column, zoom: int = 18, scale: int = 2) -> Column:
    """Web-Mercator ground resolution at a latitude: an alternative to the fixed default."""
    return F.cos(F.radians(lat)) * F.lit(2 * math.pi * 6_378_137.0 / (256 * scale * 2**zoom))

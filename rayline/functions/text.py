"""Text rules shared by sources, names and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What counts as a number in a coordinate: decimal notation, NaN and Infinity, an optional type letter.
NUMBER = r"^[+-]?(NaN|Infinity|(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[fFdD]?)$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used; keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without leading and trailing control characters and spaces (all code points up to U+0020)."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def split_fields(c: Column, delimiter: str) -> Column:
    """Fields between delimiters; empty fields at the end do not count."""
    return F.split(F.regexp_replace(c, f"{delimiter}+$", ""), delimiter)


def yes_no(c: Column) -> Column:
    return F.when(c, "YES").otherwise("NO")


def coordinate_text(lat: Column, lon: Column) -> Column:
    """`lat,lon` in the shortest decimal form of each, without a space; also the key of lookup tables."""
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def point_label(lat: Column, lon: Column) -> Column:
    return F.format_string("GeoPoint[lat=%.6f, lon=%.6f]", lat, lon)


def angles_label(left: Column, right: Column) -> Column:
    return F.format_string("BearingAngles[left=%.2f°, right=%.2f°]", left, right)


def parse_coordinate(c: Column) -> Column:
    """struct(lat, lon) of `lat, lon`; null unless there are exactly two numbers.

    An empty text after the last comma does not count as a part, so `1,2,` is a coordinate and `1,2,3` is not.
    """
    number = lambda x: F.regexp_replace(x, "[fFdD]$", "").try_cast("double")
    good = lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).rlike(NUMBER) & F.get(p, F.lit(1)).rlike(NUMBER)
    point = lambda p: F.struct(number(F.get(p, F.lit(0))).alias("lat"), number(F.get(p, F.lit(1))).alias("lon"))
    return let(F.transform(split_fields(c, ","), trimmed), lambda p: F.when(good(p), point(p)))

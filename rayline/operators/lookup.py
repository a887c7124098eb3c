"""Road names of points through two keyed lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.payloads import route_name, route_without_name, snapped_place


def point_names(snaps: DataFrame, places: DataFrame) -> DataFrame:
    """(point_key, place_id, road_name, lookup_error) for each point that has a snap response.

    A point without a place or a route has no name; a route whose name is missing is an error.  Bodies are parsed
    before the join, so only ids and names travel.  Of several responses for a point, or for its place, one counts (one
    with a place, and with a name, before others).
    """
    snapped = snaps.where("point_key is not null").select("point_key", snapped_place(F.col("body")).alias("place_id"))
    named = places.select("place_id", route_name(F.col("body")).alias("road_name"), F.when(route_without_name(F.col("body")), "route without a name").alias("lookup_error"))
    answer = F.max(F.struct("place_id", "road_name", "lookup_error")).alias("answer")
    return snapped.join(named, "place_id", "left").groupBy("point_key").agg(answer).select("point_key", "answer.*")


def resolve_names(points: DataFrame, snaps: DataFrame, places: DataFrame) -> DataFrame:
    """The names of point_names() for each distinct point; one without a snap response has none."""
    return points.select("point_key").distinct().join(point_names(snaps, places), "point_key", "left")


def still_missing(points: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct keys that a lookup table does not hold yet: what a live service has to be asked."""
    return points.select(key).where(F.col(key).isNotNull()).distinct().join(table.select(key), key, "left_anti")

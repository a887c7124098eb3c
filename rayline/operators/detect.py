"""From a pair of fixes to the nearest road ahead on either side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Settings
from ..functions import geo, rays
from ..functions.text import coordinate_text
from .lookup import point_names
from .scan import scan_rays


def with_angles(pairs: DataFrame, offset: float = 25.0) -> DataFrame:
    """Add `angles` = struct(left, right) to rows with structs `previous` and `current`."""
    cur, prev = F.col("current"), F.col("previous")
    return pairs.withColumn("angles", geo.search_angles((cur["lat"], cur["lon"]), (prev["lat"], prev["lon"]), offset))


def choose(left: Column, right: Column, left_angle: Column, right_angle: Column) -> Column:
    """The nearer hit as primary, the other as alternative; a tie goes left.

    struct(distance, angle, alt_distance, alt_angle).  Without any hit distance and angles are 0.  With one hit the
    alternative has no distance but keeps the missed ray's angle.
    """
    use_left = left.isNotNull() & (right.isNull() | (left <= right))
    none = left.isNull() & right.isNull()
    zero = F.lit(0.0)
    return F.struct(
        F.when(none, zero).when(use_left, left).otherwise(right).alias("distance"),
        F.when(none, zero).when(use_left, left_angle).otherwise(right_angle).alias("angle"),
        F.when(use_left, right).otherwise(left).alias("alt_distance"),
        F.when(none, zero).when(use_left, right_angle).otherwise(left_angle).alias("alt_angle"),
    )


def with_targets(hits: DataFrame) -> DataFrame:
    """From `hits` = struct(left, right): the choice, the target point and the alternative's point.

    Without a hit the target is the current position; without an alternative its point is null.
    """
    cur = F.col("current")
    chosen = hits.withColumn("chosen", choose(F.col("hits.left"), F.col("hits.right"), F.col("angles.left"), F.col("angles.right")))
    found = F.col("hits.left").isNotNull() | F.col("hits.right").isNotNull()
    at = lambda d, a: geo.project(cur["lat"], cur["lon"], F.col(d), F.col(a))
    return chosen.withColumns(
        {
            "found": found,
            "target": F.when(found, at("chosen.distance", "chosen.angle")).otherwise(cur),
            "alt_point": F.when(F.col("chosen.alt_distance").isNotNull(), at("chosen.alt_distance", "chosen.alt_angle")),
        }
    )


def point_key(point: str) -> Column:
    """What lookup tables call a point: its text."""
    return coordinate_text(F.col(f"{point}.lat"), F.col(f"{point}.lon"))


def scan_tiles(pairs: DataFrame, tiles: DataFrame, settings: Settings = Settings(), key: Callable[[str], Column] = point_key) -> DataFrame:
    """Scan both rays of each pair over the raster of its current position: adds `angles`, `error` and `hits`."""
    keyed = with_angles(pairs, settings.angle_offset)
    return scan_rays(keyed, tiles, key("current"), F.col("angles.left"), F.col("angles.right"), settings)


def detect(pairs: DataFrame, tiles: DataFrame, snaps: DataFrame, places: DataFrame, settings: Settings = Settings(), key: Callable[[str], Column] = point_key) -> DataFrame:
    """The whole detection: adds target, chosen, road_name, alternative_road_name and error to each pair.

    `pairs` has structs `previous` and `current`.  Lookup tables are keyed by point text and place id; with `key`, by what
    it makes of a struct's name and the pair's columns, so that pairs at one place can have answers of their own.  A lookup
    without an answer is an unknown road, a missing raster an error.  Of several answers for a key one counts, so each pair
    gives one row.  The plan scans once and is a line from there: what the scan found is joined to the names of its
    points, first the target's, then the alternative's.
    """
    scanned = with_targets(scan_tiles(pairs, tiles, settings, key))
    # Rows without a point to look up match nothing; a key of their own each keeps them from meeting in one task.
    none = F.concat(F.lit("none "), F.col("_turn").cast("string"))
    keyed = scanned.withColumn("_turn", F.monotonically_increasing_id()).withColumns(
        {"_main": F.when(F.col("found"), key("target")).otherwise(none), "_other": F.when(F.col("alt_point").isNotNull(), key("alt_point")).otherwise(none)}
    )
    names = point_names(snaps, places)
    main = names.select(F.col("point_key").alias("_main"), F.col("road_name"), F.col("lookup_error").alias("_e1"))
    other = names.select(F.col("point_key").alias("_other"), F.col("road_name").alias("alternative_road_name"), F.col("lookup_error").alias("_e2"))
    out = keyed.join(main, "_main", "left").join(other, "_other", "left")
    return out.withColumn("error", F.coalesce("error", "_e1", "_e2")).drop("_main", "_other", "_e1", "_e2", "_turn")


def result_text(d: DataFrame) -> Column:
    """The eight-line rendering of a detection; unknown names are `unknown`, a missing distance is 0.00."""
    from ..functions.text import point_label

    lines = "\n".join(
        [
            "DetectionResult {",
            "  currentPosition  = %s",
            "  targetPoint      = %s",
            "  distance         = %.2f m",
            "  searchAngle      = %.2f°",
            "  road             = %s",
            "  alternativeRoad  = %s (%.2f m, %.2f°)",
            "}",
        ]
    )
    return F.format_string(
        lines,
        point_label(d["current"]["lat"], d["current"]["lon"]),
        point_label(d["target"]["lat"], d["target"]["lon"]),
        d["chosen"]["distance"],
        d["chosen"]["angle"],
        F.coalesce(d["road_name"], F.lit("unknown")),
        F.coalesce(d["alternative_road_name"], F.lit("unknown")),
        F.coalesce(d["chosen"]["alt_distance"], F.lit(0.0)),
        d["chosen"]["alt_angle"],
    )


def sweep(pairs: DataFrame, road, width: int, height: int, offsets: list[float], settings: Settings = Settings()) -> DataFrame:
    """Any number of rays per pair: (offset, angle, metres) per offset from the direction of travel."""
    cur, prev = F.col("current"), F.col("previous")
    heading = geo.bearing(prev["lat"], prev["lon"], cur["lat"], cur["lon"])
    rows = pairs.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("angle", geo.normalize(heading + F.col("offset")))
    return rows.withColumn("metres", rays.scan_mask(F.col("angle"), road, width, height, settings.skip_pixels, settings.step_size, settings.metres_per_pixel))

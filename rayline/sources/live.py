"""A live run's tables: rasters, snap and place responses of the points that pairs lead to, asked once each."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions.payloads import snapped_place
from ..functions.text import coordinate_text
from ..operators.detect import scan_tiles, with_targets
from ..operators.lookup import still_missing
from ..schema import PLACES, SNAPS, TILES
from .images import decoded_tiles
from .services import MAP_URL, PLACE_URL, SNAP_URL, fill, map_request, place_request, snap_request

log = logging.getLogger("rayline")


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A lookup table of a folder; one that does not exist yet is empty."""
    schema = {"tiles": TILES, "snaps": SNAPS, "places": PLACES}[name]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)


def _point(name: str):
    return coordinate_text(F.col(f"{name}.lat"), F.col(f"{name}.lon")).alias("point_key")


def fill_tables(spark: SparkSession, pairs: DataFrame, folder: str, s: Settings, urls: tuple[str, str, str] = (MAP_URL, SNAP_URL, PLACE_URL), workers: int = 4) -> dict[str, int]:
    """Ask the services for what the tables in `folder` lack to detect `pairs`, and add it; the rows added to each.

    A request that fails leaves no row, so the next call asks again.  Each table is written before it is read: a
    service is never asked by a plan that is run twice.
    """
    requests = {"tiles": map_request, "snaps": snap_request, "places": place_request}
    added = {}

    def add(name: str, url: str, wanted: DataFrame, key: str) -> None:
        asked = still_missing(wanted, stored(spark, folder, name), key)
        responses = fill(asked, key, lambda value, s: requests[name](value, s, url), s, workers, binary=name == "tiles").where("body is not null")
        before = stored(spark, folder, name).count()
        (decoded_tiles(responses) if name == "tiles" else responses.select(key, "body")).write.mode("append").parquet(f"{folder}/{name}")
        added[name] = stored(spark, folder, name).count() - before
        log.info("%s: %d rows added", name, added[name])

    add("tiles", urls[0], pairs.select(_point("current")), "point_key")
    found = with_targets(scan_tiles(pairs, stored(spark, folder, "tiles"), s))
    points = found.where("found").select(_point("target")).union(found.where("alt_point is not null").select(_point("alt_point")))
    add("snaps", urls[1], points, "point_key")
    snapped = points.join(stored(spark, folder, "snaps"), "point_key").select(snapped_place(F.col("body")).alias("place_id"))
    add("places", urls[2], snapped, "place_id")
    return added

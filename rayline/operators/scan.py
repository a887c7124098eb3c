"""Rays over rasters, tile by tile.

The raster of a point and the rays from it are brought to one task, the raster first, so image bytes cross to Python
once however many rays there are, and all rays of a batch are scanned as one array.  A point of very many rays is cut
into copies of its raster, each with a bounded share of the rays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.rays import first_hits
from .size import gated

#: About so many rows of one point go to a task.
ROWS_A_COPY = 5_000
MISSING, BROKEN = "no raster for this position", "raster could not be decoded"


def _raster(tile: pa.StructArray, i: int) -> tuple[np.ndarray | None, str | None]:
    """The pixels of a tile, or what is wrong with it."""
    width, height, channels = (tile.field(c)[i].as_py() for c in ("width", "height", "nChannels"))
    data = tile.field("data")[i]
    if width is None or width <= 0 or not data.is_valid:
        return None, BROKEN
    return np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, channels), None


def _scan(skip: int, step: float, metres_per_pixel: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pixels, wrong = None, None, MISSING
        for b in batches:
            keys = list(zip(b.column("point_key").to_pylist(), b.column("copy").to_pylist(), strict=True))
            is_ray = b.column("is_ray").to_numpy(zero_copy_only=False)
            angles = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("left", "right")])
            metres, errors = np.full(angles.shape, np.nan), [None] * len(keys)
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[s] != at:
                    at, pixels, wrong = keys[s], None, MISSING
                while s < e and not is_ray[s]:  # of several rasters the first counts
                    if wrong is MISSING:
                        pixels, wrong = _raster(b.column("tile"), s)
                    s += 1
                if pixels is None:
                    errors[s:e] = [wrong] * (e - s)
                elif s < e:
                    metres[:, s:e] = first_hits(pixels, angles[:, s:e].ravel(), skip, step, metres_per_pixel).reshape(2, -1)
            columns = [b.column("row"), pa.array(errors, pa.string()), *(pa.array(m, mask=np.isnan(m)) for m in metres)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "error", "left", "right"]).filter(pa.array(is_ray))

    return run


def scan_rays(rows: DataFrame, tiles: DataFrame, key: Column, left: Column, right: Column, settings: Settings = Settings()) -> DataFrame:
    """`rows` with `error` and `hits` = struct(left, right): metres to the first road pixel on each ray, or null.

    `key` is the point whose raster in `tiles` (point_key, image) is scanned at the two compass angles.  A point without
    a raster, or with one that could not be decoded, is an error.  Of a point's rasters one counts.
    """
    rows = rows.drop("error", "hits")
    rays = rows.select(key.alias("point_key"), left.cast("double").alias("left"), right.cast("double").alias("right"), F.struct(F.col("*")).alias("row"))
    image = F.col("image")
    tile = F.struct(*[image[c].alias(c) for c in ("width", "height", "nChannels", "data")])
    rasters = tiles.where("point_key is not null and image is not null").select("point_key", tile.alias("tile"))
    many = rays.where("point_key is not null").groupBy("point_key").agg(F.count("*").alias("rows")).where(F.col("rows") > ROWS_A_COPY)
    many = gated(many.select(F.col("point_key").alias("many_key"), F.ceil(F.col("rows") / ROWS_A_COPY).cast("int").alias("copies")))
    is_many, copies = F.col("point_key") == F.col("many_key"), F.coalesce("copies", F.lit(1))
    # A row without a point has no raster: such rows are spread, too.
    turn = F.monotonically_increasing_id()
    dealt = rays.withColumn("turn", turn).join(many, is_many, "left").select(
        "point_key", F.when(F.col("point_key").isNull(), F.col("turn") % 1000).otherwise(F.pmod(F.col("turn"), copies)).cast("int").alias("copy"),
        F.lit(True).alias("is_ray"), F.lit(None).cast(rasters.schema["tile"].dataType).alias("tile"), "left", "right", "row",
    )
    shared = rasters.join(many, is_many, "left").select(
        "point_key", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(False).alias("is_ray"), "tile",
        *[F.lit(None).cast("double").alias(c) for c in ("left", "right")], F.lit(None).cast(rays.schema["row"].dataType).alias("row"),
    )
    together = shared.unionByName(dealt).repartition("point_key", "copy").sortWithinPartitions("point_key", "copy", "is_ray")
    kinds = T.StructType([T.StructField("row", rays.schema["row"].dataType), T.StructField("error", T.StringType()), T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType())])
    found = together.mapInArrow(_scan(settings.skip_pixels, settings.step_size, settings.metres_per_pixel), kinds)
    return found.select("row.*", "error", F.when(F.col("error").isNull(), F.struct("left", "right")).alias("hits"))

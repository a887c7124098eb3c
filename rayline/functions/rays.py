"""Rays through a raster.

scan_mask() is a pure expression over a predicate of pixel coordinates: no rows are made and nothing is shuffled.
first_hits() scans the pixels of a decoded image, stepping as the incremental definition does.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

from .geo import screen_radians
from .text import let

SKIP, STEP, METRES_PER_PIXEL = 50, 1.0, 0.265
#: Samples of a ray, and rays, that are looked at together.
SAMPLES, RAYS_AT_ONCE = 64, 4096
#: A sample this little below a pixel's edge counts as on it, so that the last bit of an angle does not decide.
GUARD = 1e-9


def is_road(r: Column, g: Column, b: Column) -> Column:
    """Nearly pure green."""
    return (g > 200) & (r < 50) & (b < 50)


def inside(x: Column, y: Column, width: int, height: int) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def most_steps(width: int, height: int, skip: int = SKIP, step: float = STEP) -> int:
    return max(0, math.ceil((math.hypot(width, height) / 2 - skip) / step))


def scan_mask(angle: Column, road: Callable[[Column, Column], Column], width: int, height: int, skip: int = SKIP, step: float = STEP, metres_per_pixel: float = METRES_PER_PIXEL) -> Column:
    """Metres to the first road pixel on a ray from the centre, or null.

    `road` takes integer pixel coordinates.  Sample k lies at skip + k * step pixels, which is its distance, so that hits
    at the same sample of two rays are equal; the pixel is its floor, guarded against the last bit.  A ray ends where it
    leaves the image, so later samples do not count.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    cell = lambda v: F.floor(v + GUARD).cast("int")
    last = most_steps(width, height, skip, step)

    def along(d: Column) -> Column:
        dx, dy = d["dx"], d["dy"]

        def hit(k: Column) -> Column:
            x, y = F.lit(width / 2.0) + (skip + k * step) * dx, F.lit(height / 2.0) + (skip + k * step) * dy
            return inside(x, y, width, height) & road(cell(x), cell(y))

        # Samples are looked at in stretches that grow; those after the first hit are left alone.
        first = F.coalesce(*[F.get(F.filter(F.sequence(F.lit(lo), F.lit(hi)), hit), F.lit(0)) for lo, hi in stretches(last)])
        return (F.lit(float(skip)) + first * F.lit(float(step))) * F.lit(metres_per_pixel)

    a = screen_radians(angle)
    return let(F.struct(F.cos(a).alias("dx"), F.sin(a).alias("dy")), along)


def stretches(last: int) -> list[tuple[int, int]]:
    """0 to last, cut where 8, 24, 56 and so on samples are done."""
    out, lo, size = [], 0, 8
    while lo <= last:
        out.append((lo, min(last, lo + size - 1)))
        lo, size = lo + size, 2 * size
    return out


def first_hits(pixels: np.ndarray, angles: np.ndarray, skip: int = SKIP, step: float = STEP, metres_per_pixel: float = METRES_PER_PIXEL) -> np.ndarray:
    """The same for many rays over one decoded image (height, width, channels in BGR order), adding step after step.

    Pixels are guarded as in scan_mask(), so sums that end a last bit below an edge find the same pixel.
    Metres by ray; NaN where there is no road, and for an angle that is no number.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    height, width, channels = pixels.shape
    out = np.full(len(angles), np.nan)
    if channels < 3:
        return out  # grey is never road
    a = np.radians((np.asarray(angles, float) + 270.0) % 360.0)
    cx, cy, dx, dy = width / 2.0, height / 2.0, np.cos(a), np.sin(a)
    x, y = cx + skip * dx, cy + skip * dy
    rays, done = np.flatnonzero((x >= 0) & (x < width) & (y >= 0) & (y < height)), 0
    while len(rays):
        for some in np.array_split(rays, -(-len(rays) // RAYS_AT_ONCE)):
            xs, ys = (np.cumsum(np.concatenate([v[some, None], np.repeat(step * d[some, None], SAMPLES, axis=1)], axis=1), axis=1) for v, d in ((x, dx), (y, dy)))
            x[some], y[some] = xs[:, -1], ys[:, -1]  # where the next samples begin
            xs, ys = xs[:, :-1], ys[:, :-1]
            within = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
            row, column = (np.minimum((np.where(within, v, 0) + GUARD).astype(np.intp), most - 1) for v, most in ((ys, height), (xs, width)))
            found = pixels[row, column]
            road = within & (found[:, :, 1] > 200) & (found[:, :, 2] < 50) & (found[:, :, 0] < 50)
            at = road.argmax(axis=1)
            hit = road[np.arange(len(some)), at]
            out[some[hit]] = (skip + (done + at[hit]) * step) * metres_per_pixel
        done += SAMPLES
        rays = rays[np.isnan(out[rays]) & (x[rays] >= 0) & (x[rays] < width) & (y[rays] >= 0) & (y[rays] < height)]
    return out


def ray_hit(pixels: np.ndarray, angle: float, skip: int = SKIP, step: float = STEP, metres_per_pixel: float = METRES_PER_PIXEL) -> float | None:
    """One ray over one image, or None."""
    found = first_hits(pixels, np.array([angle]), skip, step, metres_per_pixel)[0]
    return None if np.isnan(found) else float(found)

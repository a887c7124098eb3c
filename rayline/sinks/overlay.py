"""Annotated rasters of failed cases."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import cache, lru_cache
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.names import same_ignoring_case
from ..functions.text import coordinate_text
from ..schema import FAIL
from ..sources.images import encode_png

#: Colours and sizes of the layers.
WHITE, RED, YELLOW, CYAN, BLACK = (255, 255, 255), (255, 0, 0), (255, 220, 0), (0, 255, 255), (0, 0, 0)
CROSS, RING, DOT, ARROW, ARROW_HEAD, ARROW_SPREAD, BOX_ALPHA = 14, 10, 3, 70, 10, 0.45, 190
#: A 3 x 5 dot font: five rows of three dots per character, a digit 0-7 each; others are a box.
FONT = {
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152",
    "K": "55655", "L": "44447", "M": "57755", "N": "65555", "O": "25552", "P": "65644", "Q": "25563", "R": "65655", "S": "34216", "T": "72222",
    "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247", "0": "75557", "1": "26227", "2": "71747", "3": "71717",
    "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", " ": "00000", "#": "57575", "-": "00700", ":": "02020",
    "?": "71202", "(": "24442", ")": "21112", "=": "07070", ".": "00002", ",": "00024", "/": "11244", "'": "22000",
}


def caption_lines(row: Column, target: Column, primary: Column, alternative: Column) -> Column:
    """The five caption lines.  MATCH means the primary name equals the target but for case; no fuzzy rule here."""
    match = F.when(F.coalesce(same_ignoring_case(primary, target), F.lit(False)), "MATCH").otherwise("MISMATCH")
    return F.array(
        F.format_string("Case #%03d — %s", row, match),
        F.format_string("Expected cross-street:  %s", target),
        F.format_string("Detected (yellow):      %s", F.coalesce(primary, F.lit("(none)"))),
        F.format_string("Alternative (cyan):     %s", F.coalesce(alternative, F.lit("(none)"))),
        F.lit("White arrow = heading  •  Red cross = current position"),
    )


class Canvas:
    """Draws on an RGB array; what lies outside is cut off."""

    def __init__(self, pixels: np.ndarray) -> None:
        self.p = np.array(pixels, order="C")
        self.flat = [self.p.reshape(-1)[c::3] for c in range(3)]

    def dots(self, x: np.ndarray, y: np.ndarray, colour: tuple) -> None:
        height, width = self.p.shape[:2]
        if x.min() < 0 or y.min() < 0 or x.max() >= width or y.max() >= height:
            ok = (x >= 0) & (y >= 0) & (x < width) & (y < height)
            x, y = x[ok], y[ok]
        at = y * width + x
        for channel, value in enumerate(colour):
            self.flat[channel][at] = value

    def line(self, x1: int, y1: int, x2: int, y2: int, colour: tuple) -> None:
        self.dots(*line_dots(x1, y1, x2, y2), colour)

    def ring(self, x: int, y: int, radius: int, colour: tuple) -> None:
        dx, dy = ring_steps(radius)
        self.dots(np.rint(x + dx).astype(int), np.rint(y + dy).astype(int), colour)

    def disc(self, x: int, y: int, radius: int, colour: tuple) -> None:
        dx, dy = disc_steps(radius)
        self.dots(x + dx, y + dy, colour)

    def shade(self, x: int, y: int, w: int, h: int, alpha: int) -> None:
        part = self.p[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
        part[:] = (np.arange(256) * (255 - alpha) // 255).astype(np.uint8)[part]

    def text(self, x: int, y: int, text: str, colour: tuple, size: int = 2) -> None:
        on_x, on_y = text_dots(text.upper(), size)
        if len(on_x):
            self.dots(x + on_x, y + on_y, colour)


@lru_cache(2048)
def line_dots(x1: int, y1: int, x2: int, y2: int) -> tuple[np.ndarray, np.ndarray]:
    """A line two dots wide; arrows of one length have few ends, so most are known."""
    n = max(abs(x2 - x1), abs(y2 - y1)) + 1
    x, y = np.rint(np.linspace(x1, x2, n)).astype(int), np.rint(np.linspace(y1, y2, n)).astype(int)
    return np.concatenate([x, x + 1, x]), np.concatenate([y, y, y + 1])


@cache
def ring_steps(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """From the centre to a ring two dots wide."""
    a = np.linspace(0, 2 * math.pi, 16 * radius)
    return tuple(np.concatenate([r * part(a) for r in (radius, radius + 1)]) for part in (np.cos, np.sin))


@cache
def disc_steps(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """From the centre to all dots of a disc."""
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    on = dx**2 + dy**2 <= radius**2
    return dx[on], dy[on]


@lru_cache(512)
def text_dots(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A line's dots; most lines of captions are met again."""
    dots = [glyph(FONT.get(c, "77777"), size) for c in text]
    none = np.empty(0, int)
    return np.concatenate([none, *(x + i * 4 * size for i, (x, _) in enumerate(dots))]), np.concatenate([none, *(y for _, y in dots)])


@cache
def glyph(rows: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A character's dots, each a square of `size`; a column of space comes after it."""
    dots = np.array([[bits >> 2 & 1, bits >> 1 & 1, bits & 1, 0] for bits in map(int, rows)], bool)
    on_y, on_x = np.nonzero(np.kron(dots, np.ones((size, size), bool)))
    return on_x, on_y


def draw(pixels: np.ndarray, heading: float, hits: list[tuple[int, int, tuple, str]], caption: list[str]) -> np.ndarray:
    """Layers from bottom to top: heading arrow, hits with labels, centre cross, caption."""
    c = Canvas(pixels)
    height, width = pixels.shape[:2]
    cx, cy = width // 2, height // 2
    a = math.radians((heading + 270.0) % 360.0)
    ex, ey = math.floor(cx + ARROW * math.cos(a) + 0.5), math.floor(cy + ARROW * math.sin(a) + 0.5)
    c.line(cx, cy, ex, ey, WHITE)
    tip = math.atan2(ey - cy, ex - cx)
    for side in (-ARROW_SPREAD, ARROW_SPREAD):
        c.line(ex, ey, int(ex - ARROW_HEAD * math.cos(tip + side)), int(ey - ARROW_HEAD * math.sin(tip + side)), WHITE)
    for x, y, colour, label in hits:
        c.ring(x, y, RING, colour)
        c.disc(x, y, DOT, colour)
        c.text(x + RING + 5, y - 4, label, BLACK)
        c.text(x + RING + 4, y - 5, label, colour)
    c.line(cx - CROSS, cy, cx + CROSS, cy, RED)
    c.line(cx, cy - CROSS, cx, cy + CROSS, RED)
    line, pad = 14, 8
    w, h = 8 * max(map(len, caption), default=0) + 2 * pad, line * len(caption) + 2 * pad
    c.shade((width - w) // 2, height - h - 8, w, h, BOX_ALPHA)
    for i, text in enumerate(caption):
        c.text((width - w) // 2 + pad, height - h - 8 + pad + i * line, text, WHITE)
    return c.p


def overlays(results: DataFrame, tiles: DataFrame, metres_per_pixel: float = 0.265) -> DataFrame:
    """(row_number, file_name, png) of each failed case; others are filtered out before any image is read."""
    cur, prev, chosen = F.col("current"), F.col("previous"), F.col("chosen")
    centre = [F.floor(F.col(f"image.{c}") / 2).cast("double") for c in ("width", "height")]
    pixel = lambda d, a: geo.to_pixel(*centre, chosen[d], chosen[a], metres_per_pixel)
    failed = results.where(F.col("outcome") == FAIL).withColumn("point_key", coordinate_text(cur["lat"], cur["lon"]))
    rows = failed.join(tiles.select("point_key", "image"), "point_key").where("image.width > 0").select(
        "row_number",
        geo.bearing(prev["lat"], prev["lon"], cur["lat"], cur["lon"]).alias("heading"),
        F.when(chosen["distance"] > 0, pixel("distance", "angle")).alias("main"),
        F.when(chosen["alt_distance"].isNotNull(), pixel("alt_distance", "alt_angle")).alias("other"),
        F.concat(F.lit("P: "), F.coalesce("road_name", F.lit("?"))).alias("main_label"),
        F.concat(F.lit("A: "), F.coalesce("alternative_road_name", F.lit("?"))).alias("other_label"),
        caption_lines(F.col("row_number"), F.col("target_road"), F.col("road_name"), F.col("alternative_road_name")).alias("caption"),
        "image.width", "image.height", "image.nChannels", "image.data",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgb = raw[:, :, 2::-1] if r.nChannels >= 3 else np.repeat(raw, 3, axis=2)
                marks = [(m["x"], m["y"], colour, label) for m, colour, label in ((r.main, YELLOW, r.main_label), (r.other, CYAN, r.other_label)) if m is not None]
                out.append((r.row_number, f"case-{r.row_number:03d}.png", encode_png(draw(rgb, r.heading, marks, list(r.caption)))))
            yield pd.DataFrame(out, columns=["row_number", "file_name", "png"])

    return rows.mapInPandas(run, "row_number int, file_name string, png binary")


def save_overlays(images: DataFrame, folder: str) -> int:
    """Write each image as a file into a folder that driver and executors share; their number.

    Tasks write their own files, and each appears whole or not at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, png in zip(b["file_name"], b["png"], strict=True):
                part = os.path.join(folder, f".{name}.{uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(png)
                os.replace(part, os.path.join(folder, name))
            yield pd.DataFrame({"files": [len(b)]})

    os.makedirs(folder, exist_ok=True)
    written = images.select("file_name", "png").mapInPandas(run, "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]

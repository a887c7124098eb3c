"""Rasters as tables, from files or from fetched bytes; PNG without a library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TILES

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples of a pixel by colour type; first row, first column and steps of the seven passes.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: A batch of decoded rasters ends once it has so many bytes.
BATCH_BYTES = 4_000_000
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(point_key, image) of a folder of images named by point, such as `38.016989,24.419658.png`.

    A file that is no image has width -1 and becomes an error later; it does not fail the read.
    """
    images = spark.read.format("image").load(path)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[A-Za-z]+$", ""))
    return images.select(name.alias("point_key"), "image")


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB array (height, width, 3) as PNG."""
    height, width, _ = pixels.shape

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((height, 1 + width * 3), np.uint8)
    rows[:, 1:] = pixels.reshape(height, width * 3)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bytes (height, width, bytes of a pixel) as they were before each row's filter.

    Rows that follow from the left or from above alone are computed whole.  Otherwise a byte follows from the ones to its
    left and above, so all bytes of a diagonal are computed at once.
    """
    height, width, size = rows.shape
    if (kinds <= 2).all():
        whole = rows.copy()
        for r in np.flatnonzero(kinds):
            if kinds[r] == 1:
                np.cumsum(rows[r], axis=0, dtype=np.uint8, out=whole[r])
            elif r:
                whole[r] += whole[r - 1]
        return whole
    out = np.zeros((height + 1, width + 1, size), np.int16)
    for t in range(height + width - 1):
        r = np.arange(max(0, t - width + 1), min(height, t + 1))
        c = t - r
        left, up, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r, None]
        guess = left + up - corner
        to_left, to_up, to_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[r + 1, c + 1] = (rows[r, c] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(data: bytes, at: int, width: int, height: int, depth: int, samples: int) -> tuple[np.ndarray, int]:
    """One pass: samples (height, width, samples) as whole numbers, and the offset after it."""
    size, length = max(1, depth * samples // 8), -(-width * depth * samples // 8)
    block = np.frombuffer(data, np.uint8, height * (length + 1), at).reshape(height, length + 1)
    if (block[:, 0] > 4).any():
        raise ValueError("unknown filter")
    rows = unfiltered(block[:, 1:].reshape(height, -1, size), block[:, 0]).reshape(height, length)
    if depth == 16:
        rows = rows[:, ::2]  # the upper byte
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return rows[:, : width * samples].reshape(height, width, samples), at + block.size


def decode_png(data: bytes) -> np.ndarray:
    """A PNG as an array (height, width, channels): grey, or in BGR or BGRA order; ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    parts: dict[bytes, bytes] = {}
    at = 8
    while at + 12 <= len(data) and b"IEND" not in parts:
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + length]
        at += 12 + length
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        raw, samples = zlib.decompress(parts[b"IDAT"]), SAMPLES[colour]
        if not interlaced:
            pixels, _ = _samples(raw, 0, width, height, depth, samples)
        else:
            pixels, at = np.zeros((height, width, samples), np.uint8), 0
            for top, first, down, across in PASSES:
                h, w = -(-(height - top) // down), -(-(width - first) // across)
                if h > 0 and w > 0:
                    pixels[top::down, first::across], at = _samples(raw, at, w, h, depth, samples)
        if colour == 3:
            palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
            if b"tRNS" in parts:
                clear = np.full((len(palette), 1), 255, np.uint8)
                clear[: len(parts[b"tRNS"]), 0] = np.frombuffer(parts[b"tRNS"], np.uint8)
                palette = np.concatenate([palette, clear], axis=1)
            pixels = palette[pixels[:, :, 0]]
        elif colour in (0, 4):
            scale = 255 // ((1 << depth) - 1) if depth < 8 else 1
            return pixels[:, :, :1] * np.uint8(scale)
    except (KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"damaged PNG: {e}") from e
    return np.concatenate([pixels[:, :, 2::-1], pixels[:, :, 3:]], axis=2)


def decoded_tiles(responses: DataFrame) -> DataFrame:
    """(point_key, image) of fetched rasters (point_key, body): what services.fill() returns for map requests.

    A request without a body has no raster; a body that is no image has width -1, as in read_tiles().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        columns = [f.name for f in kind]

        def batch(images: list[tuple]) -> pa.RecordBatch:
            parts = [pa.array(values, kind.field(c).type) for c, values in zip(columns, zip(*images, strict=True), strict=True)]
            return pa.RecordBatch.from_arrays([parts[0], pa.StructArray.from_arrays(parts, columns)], ["point_key", "image"])

        for b in batches:
            images, held = [], 0
            for key, body in zip(b.column("point_key").to_pylist(), b.column("body"), strict=True):
                image = (key, -1, -1, -1, -1, b"")
                try:
                    pixels = decode_png(body.as_py())
                    height, width, channels = pixels.shape
                    image = (key, height, width, channels, 8 * (channels - 1), pixels.tobytes())
                except ValueError:
                    pass
                images.append(image)
                held += len(image[-1])
                if held >= BATCH_BYTES:
                    yield batch(images)
                    images, held = [], 0
            if images:
                yield batch(images)

    return responses.where("body is not null").select("point_key", "body").mapInArrow(run, TILES)

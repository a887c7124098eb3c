"""Elias-Fano code of a non-decreasing sequence, with a select directory.

Each value's low bits stand in a packed array, its high bits as the place of a one in a bit vector, about two bits a
value.  The directory counts the ones before each block of 512 bits in 32-bit numbers, so that the i-th value is
found by a search in the directory and a look at one block.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

BLOCK_BITS = 512
_HEAD = struct.Struct("<QQBQ")


@dataclass
class EliasFano:
    size: int
    top: int
    low_bits: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # packed bits, padded to whole blocks
    before: np.ndarray  # ones before each block

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = int(places[-1]) + 1 if n else 0
        marks = np.zeros(-(-length // BLOCK_BITS) * BLOCK_BITS, np.uint8)
        marks[places] = 1
        ones = marks.reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.int64)
        return cls(n, top, bits, np.packbits(low.reshape(-1), bitorder="little"), np.packbits(marks, bitorder="little"), (np.cumsum(ones) - ones).astype(np.uint32))

    def select(self, i: int | np.ndarray) -> int | np.ndarray:
        """The value at an index, or those at an array of indices, as signed 64-bit numbers.

        The directory leads to a block for each; only these blocks are unpacked.
        """
        at = np.atleast_1d(np.asarray(i, np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.size):
            raise IndexError(i)
        blocks, which = np.unique(np.searchsorted(self.before, at, side="right") - 1, return_inverse=True)
        bits = np.unpackbits(self.high.reshape(-1, BLOCK_BITS // 8)[blocks], axis=1, bitorder="little")
        ones = bits.sum(axis=1, dtype=np.int64)
        place = np.flatnonzero(bits)[(np.cumsum(ones) - ones - self.before[blocks])[which] + at]
        place = blocks[place // BLOCK_BITS] * BLOCK_BITS + place % BLOCK_BITS
        steps = np.arange(self.low_bits, dtype=np.uint64)
        lows = at[:, None] * self.low_bits + steps.astype(np.int64)
        low = ((self.low[lows >> 3] >> (lows & 7).astype(np.uint8)) & 1).astype(np.uint64) << steps
        found = (((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | low.sum(axis=1, dtype=np.uint64)).view(np.int64)
        return found if np.ndim(i) else int(found[0])

    def values(self) -> np.ndarray:
        """All values."""
        return self.select(np.arange(self.size))

    def pack(self) -> bytes:
        return _HEAD.pack(self.size, self.top, self.low_bits, len(self.high)) + self.before.astype("<u4").tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def unpack(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The code at an offset of `data`, and the offset after it."""
        size, top, bits, high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        blocks, low = high * 8 // BLOCK_BITS, -(-size * bits // 8)
        raw = np.frombuffer(data, np.uint8, 4 * blocks + high + low, at)
        return cls(size, top, bits, raw[4 * blocks + high :], raw[4 * blocks : 4 * blocks + high], raw[: 4 * blocks].view("<u4")), at + len(raw)

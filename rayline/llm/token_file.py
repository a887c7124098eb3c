"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

The corpus is range-partitioned by document id.  A partition is written as segments in order; a segment is a file
image of its own: header, Elias-Fano codes of the document ids and of the boundaries (each with its select directory),
then the ids of all its documents, 2 bytes each where the vocabulary allows.  Readers take offsets from select alone;
no table of 64-bit offsets or names is stored.  Images are stored through Spark's table writer, in a folder that all
executors share, so a lost task or executor is simply run again; export_segments() puts them into plain files.  A
segment is bounded in ids, and one document of any length fits in one.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Batches, batch_rows, checkpointed, remove, shared_dir, tidy, write_whole
from .elias_fano import EliasFano

MAGIC = b"RLTOK\x02"
#: Magic, bytes of an id, documents with an identifier and without, the smallest identifier, ids.
_HEAD = struct.Struct("<6sBxQQqQ")
SEGMENT_IDS = 2_000_000
#: Pieces a worker remembers before it starts again.
WORDS_KEPT = 1_300_000
#: Rows whose texts are encoded together, and images read together.
BATCH_ROWS, BATCH_IMAGES = 600, 16

#: Bytes of text handled at a time; the library gets a longer text whole.
SLAB_BYTES = 2 << 20
#: A space between white space, or after some at the end: only there may a piece of the library's reach over a space.
OVER_SPACE = re.compile(r"\s (?:\s|\Z)")
#: How byte-level vocabularies split a text.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beyond ASCII.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Starts a text in a slab; no byte of UTF-8.
TEXT_START = 255


@dataclass
class Segment:
    """One file image, parsed."""

    first: int
    names: EliasFano  # identifiers above the first
    nulls: int
    bounds: EliasFano
    ids: np.ndarray

    @staticmethod
    def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: bytes, width: int) -> bytes:
        """Documents come in order of their identifiers, those without one last."""
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        if (known[1:] < known[:-1]).any() or None in doc_ids[: len(known)]:
            raise ValueError("documents out of order")
        first = int(known[0]) if len(known) else 0
        names = EliasFano.of((known - np.int64(first)).view(np.uint64))
        bounds = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
        return _HEAD.pack(MAGIC, width, len(known), len(doc_ids) - len(known), first, len(ids) // width) + names.pack() + bounds.pack() + ids

    @classmethod
    def unpack(cls, image: bytes) -> Segment:
        magic, width, docs, nulls, first, count = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        names, at = EliasFano.unpack(image, _HEAD.size)
        bounds, at = EliasFano.unpack(image, at)
        if len(image) != at + width * count or names.size != docs or bounds.size != docs + nulls + 1 or bounds.top != count:
            raise ValueError("damaged token segment")
        return cls(first, names, nulls, bounds, np.frombuffer(image, f"<u{width}", count, at))

    def doc_ids(self) -> pa.Array:
        return pa.concat_arrays([pa.array(self.names.values() + np.int64(self.first)), pa.nulls(self.nulls, pa.int64())])

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        start, end = self.bounds.select(np.array([i, i + 1]))
        return self.ids[start:end]


class _Hash:
    """Hashes of stretches of a slab: differences of prefix sums of byte codes times powers of an odd number.

    Each difference is raised to the power of the slab's far end, so that a stretch's place does not matter.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers, size, step = np.ones(SLAB_BYTES + 1, np.uint64), 1, int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
        while size <= SLAB_BYTES:  # double the filled part by the next power
            part = self.powers[size : 2 * size]
            part[:] = self.powers[: len(part)] * np.uint64(step % 2**64)
            size, step = 2 * size, step * step % 2**64

    def of(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.codes[buffer] * self.powers[: len(buffer)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.powers[SLAB_BYTES - starts]


class _Units(dict):
    """The library's own pieces by number; new ones wait in `pending` for their ids."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.pending.append(unit)
        return number


class _Ids:
    """Id sequences by number, one after the other in an array."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a list of numbers, and where each ends among them."""
        sizes = self.sizes[numbers]
        after = np.cumsum(sizes)
        return self.ids[np.arange(int(after[-1])) + np.repeat(self.starts[numbers] - after + sizes, sizes)], after


class ByteEncoder:
    """Encodes whole texts with the tokenizers library.

    The library splits a text before it merges; its own units begin at a space that follows a word and reach over no
    other.  So a text is cut before spaces into pieces, pieces are remembered under a hash with their bytes and ids,
    and of new pieces each unit goes through the library once.  Every piece is compared in full with the one it was
    found to be; a text with a piece that only shares a hash goes through the library whole, and so do texts in which
    white space or special tokens stand about a space, and ones longer than a slab.
    """

    def __init__(self, spec: str, end: int, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.width = Tokenizer.from_str(spec), end, width
        self.marks = [t["content"] for t in json.loads(spec)["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(1 + max(vocabulary.values()), np.int64)  # bytes of a token: a letter stands for each
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.hash = _Hash(1)
        self.forget()

    def forget(self) -> None:
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.seen = _Ids(np.empty(0, np.uint8), np.zeros(1, np.int64))  # the bytes of each piece
        self.known, self.spaced = _Units(), np.empty(0, bool)
        self.units = _Ids(np.empty(0, f"<u{self.width}"), np.empty(0, np.int64))
        self.pieces = _Ids(np.array([self.end], f"<u{self.width}"), np.ones(1, np.int64))  # number 0 is the end id

    def learn_units(self) -> None:
        """Have the library encode the units that wait; token lengths tell where each ends."""
        wait, self.known.pending = self.known.pending, []
        if wait:
            found = self.tokenizer.encode_batch_fast([wait[i : i + 256] for i in range(0, len(wait), 256)], is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, self.units.ids.dtype) for x in found])
            until = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            ends = np.searchsorted(until, np.cumsum(np.fromiter((len(u.encode()) for u in wait), np.int64, len(wait))))
            self.units.add(ids, np.diff(ends, prepend=0))
            self.spaced = np.concatenate([self.spaced, np.fromiter((u[0] == " " for u in wait), bool, len(wait))])

    def learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new pieces of a slab.

        Pieces of a space and a stretch that neither begins nor ends with white space can stand one after the other
        and are split all at once; there each begins at a unit with a space.  Others are split one by one.
        """
        buffer = np.frombuffer(raw, np.uint8)
        after = buffer[np.minimum(starts + 1, len(buffer) - 1)]
        ok = (buffer[starts] == 32) & (ends - starts > 1) & (after > 32) & (buffer[ends - 1] > 32)
        text = b"".join([raw[s:e] for s, e in zip(starts[ok].tolist(), ends[ok].tolist(), strict=True)]).decode()
        if WIDE_SPACE.search(text):
            ok[:], text = False, ""
        together = BYTE_PATTERN.findall(text)
        apart = [BYTE_PATTERN.findall(raw[s + (raw[s] == TEXT_START) : e].decode()) for s, e in zip(starts[~ok].tolist(), ends[~ok].tolist(), strict=True)]
        units = together + [u for some in apart for u in some]
        numbers = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        self.learn_units()
        counts = np.empty(len(starts), np.int64)
        counts[ok] = np.diff(np.flatnonzero(self.spaced[numbers[: len(together)]]), append=len(together))
        counts[~ok] = [len(some) for some in apart]
        order = np.concatenate([np.flatnonzero(ok), np.flatnonzero(~ok)])
        ids, sums = self.units.gather(numbers) if len(numbers) else (self.units.ids[:0], np.empty(0, np.int64))
        until = np.concatenate([[0], sums])[np.cumsum(counts[order])]
        out = np.empty(len(starts), np.int64)
        out[order] = len(self.pieces.sizes) + np.arange(len(starts))
        self.pieces.add(ids, np.diff(until, prepend=0))
        self.seen.add(np.frombuffer(b"".join([raw[s:e] for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]), np.uint8), (ends - starts)[order])
        return out

    def mistaken(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which pieces of a slab are not the pieces of their numbers, byte by byte."""
        other = self.seen.sizes[numbers] != sizes
        shift = np.where(other, 0, self.seen.starts[numbers]) - starts
        seen = np.take(self.seen.ids, np.arange(len(buffer)) + np.repeat(shift, sizes), mode="clip")
        return other | np.logical_or.reduceat(seen != buffer, starts)

    def slab(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of texts that can be cut before spaces; None where a piece shares its hash with another."""
        raw = b"".join(x for t in texts for x in (b"\xff", t))
        buffer = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((buffer == 32) | (buffer == TEXT_START))
        ends = np.append(starts[1:], len(buffer))
        keys, at, inverse = np.unique(self.hash.of(buffer, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        near = np.minimum(place, len(self.keys) - 1)
        known = (self.keys[near] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        numbers = np.empty(len(keys), np.int64)
        numbers[known] = self.numbers[near[known]]
        new = ~known
        if new.any():
            numbers[new] = self.learn(raw, starts[at[new]], ends[at[new]])
            self.keys, self.numbers = (np.insert(old, place[new], x[new]) for old, x in ((self.keys, keys), (self.numbers, numbers)))
        heads = np.flatnonzero(buffer[starts] == TEXT_START)
        mine = numbers[inverse]
        wrong = np.logical_or.reduceat(self.mistaken(buffer, starts, ends - starts, mine), heads)
        pieces = np.insert(mine, np.append(heads[1:], len(starts)), 0)
        ids, after = self.pieces.gather(pieces)
        lasts = np.append(heads[1:], len(starts)) + np.arange(len(heads))
        return [None if w else x for w, x in zip(wrong.tolist(), np.split(ids, after[lasts[:-1]]), strict=True)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([*x.ids, self.end], self.pieces.ids.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        waiting: list[int] = []
        raw: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if len(self.keys) > WORDS_KEPT:
                self.forget()
            found = self.slab(raw) if raw else []
            for i, ids in zip(waiting, found, strict=True):
                out[i] = self.whole([texts[i]])[0] if ids is None else ids
            waiting.clear()
            raw.clear()
            held = 0

        for i, text in enumerate(texts):
            data = text.encode()
            if len(data) >= SLAB_BYTES or any(m in text for m in self.marks) or OVER_SPACE.search(text):
                out[i] = self.whole([text])[0]
                continue
            if held + len(data) + 1 > SLAB_BYTES:
                flush()
            waiting.append(i)
            raw.append(data)
            held += len(data) + 1
        flush()
        return out


_ENCODERS: dict[tuple, ByteEncoder] = {}


def _encoder(spec: str, end: int, width: int) -> ByteEncoder:
    """One encoder per worker process, kept from task to task."""
    key = (hash(spec), end, width)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteEncoder(spec, end, width)
    return _ENCODERS[key]


SEGMENTS = "part int, seq int, base long, docs long, ids long, image binary"


def _write(spec, end: int, width: int):
    def run(batches: Batches) -> Batches:
        encoder = _encoder(spec.value, end, width)
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        coded: list[np.ndarray] = []
        size = 0

        def segment():
            image = Segment.pack(docs, np.array([len(x) for x in coded], np.int64), np.concatenate(coded).tobytes(), width)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "base": [base], "docs": [len(docs)], "ids": [size], "image": [image]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("image", pa.binary())]))

        for b in batches:
            names = b.column("doc_id").to_pylist()
            for name, ids in zip(names, encoder.encode([x or "" for x in b.column("text").to_pylist()]), strict=True):
                if coded and size + len(ids) > SEGMENT_IDS:
                    yield segment()
                    seq, base, docs, coded, size = seq + 1, base + size, [], [], 0
                docs.append(name)
                coded.append(ids)
                size += len(ids)
        if coded:
            yield segment()

    return run


def write_tokens(df: DataFrame, tokenizer: str, folder: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append `end`, and write segments in ascending order of identifiers to `folder`.

    Null identifiers come last; rows that repeat an identifier (or have none) stand next to each other, in order of
    input, and are spread over as many tasks as they fill.  A null text is the empty text: its ids are
    the end id alone.  A text of any length is one document of one segment.  Other columns are not read, and an empty
    table gives an empty folder.
    """
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(end, Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else 4
    spec = spark.sparkContext.broadcast(text)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with batch_rows(spark, BATCH_ROWS):
        ordered.mapInArrow(tidy(_write(spec, end, width), BATCH_ROWS), SEGMENTS).write.option("compression", "zstd").parquet(folder)


def _read(batches: Batches) -> Batches:
    for b in batches:
        for offset, base, image in zip(b.column("offset").to_pylist(), b.column("base").to_pylist(), b.column("image"), strict=True):
            segment = Segment.unpack(image.as_py())
            bounds = segment.bounds.select(np.arange(segment.bounds.size))
            wide = segment.ids.astype("<u4")
            crc = [zlib.crc32(wide[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [segment.doc_ids(), pa.array(bounds[:-1] + offset + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder of segments.

    Each segment knows the ids before it in its partition; the ids of earlier partitions come from one small row per
    partition.
    """
    stored = spark.read.schema(SEGMENTS).parquet(folder)
    sizes = stored.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    rows = stored.join(F.broadcast(offsets), "part").select("offset", "base", "image")
    return rows.mapInArrow(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_segments(spark: SparkSession, folder: str, target: str) -> int:
    """Write each segment as a plain file into a directory that driver and executors share; their number.

    Tasks write their own files, each whole or not at all, so a lost task is simply run again.
    """

    def run(batches: Batches) -> Batches:
        for b in batches:
            for part, seq, image in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("image"), strict=True):
                write_whole(os.path.join(target, f"tokens-{part:05d}-{seq:05d}.rltok"), [image.as_py()])
            yield pa.RecordBatch.from_pydict({"files": pa.array([b.num_rows], pa.int64())})

    stored = spark.read.schema(SEGMENTS).parquet(folder).select("part", "seq", "image")
    with batch_rows(spark, BATCH_IMAGES):
        return stored.mapInArrow(tidy(run), "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def token_round_trip(df: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the token files of a table into the shared folder and read them back; an empty table gives no rows.

    The files are deleted once they are read.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    write_tokens(df, tokenizer, folder, end)
    found = checkpointed(read_tokens(spark, folder), BATCH_IMAGES)
    remove(spark, folder)
    return found

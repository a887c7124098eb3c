"""WARC archives as a chunked record table.

A record is a row for each bounded piece of its bytes: (part, record, chunk, data) with the number of chunks, the
payload bytes so far and the digest of these.  Writer and reader handle a piece at a time, never a whole record, and
verify the digest as it grows.  The pieces of a part in order of (record, chunk) are a WARC/1.1 file, which
export_archives() writes; the table itself goes through Spark's writer into a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import groupby
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Batches, batch_rows, checkpointed, gated, remove, shared_dir, text_or_empty, tidy, write_whole

#: Bytes of payload in one chunk, and of chunks in one batch on the way to the table.
CHUNK_BYTES, BATCH_BYTES = 64 << 10, 4 << 20
#: Rows of pages, and of chunks, that Python is handed at a time.
BATCH_PAGES, BATCH_CHUNKS = 500, 200
#: Smaller payloads are never revisits.
LEAST_REVISIT = 100
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

RECORDS = pa.schema([("part", pa.int32()), ("record", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("data", pa.binary()), ("payload_so_far", pa.int64()), ("digest_so_far", pa.string())])
RECORDS_DDL = "part int, record long, chunk int, chunks int, data binary, payload_so_far long, digest_so_far string"
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:rayline:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name[len("<urn:rayline:page:") : -1]
    return int(value) if value else None


def head(page_id: int | None, url: str, size: int, digest: str, refers_to: int | None) -> bytes:
    """The record's header and, as the start of its block, the HTTP header; a revisit's block ends there."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url if c > ' ') or 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + END + http


def chunks_of(payload: memoryview, start: bytes, digest: str, revisit: bool) -> Iterator[tuple[int, bytes, int, str]]:
    """(chunks, data, payload bytes so far, digest so far) of one record, a piece at a time."""
    size = 0 if revisit else len(payload)
    count = max(1, -(-size // CHUNK_BYTES))
    seen = hashlib.sha256()
    for i in range(count):
        piece = payload[i * CHUNK_BYTES : min(size, (i + 1) * CHUNK_BYTES)]
        seen.update(piece)
        data = (start if i == 0 else b"") + bytes(piece) + (END if i == count - 1 else b"")
        yield count, data, min(size, (i + 1) * CHUNK_BYTES), seen.hexdigest()
    if not revisit and seen.hexdigest() != digest:
        raise ValueError("payload does not have its digest")


def _write(batches: Batches) -> Batches:
    part, record = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    held = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)

    for b in batches:
        html = b.column("html")
        names = ("page_id", "url", "digest", "refers_to")
        for i, (page_id, url, digest, refers_to) in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
            payload = memoryview(html[i].as_buffer())
            start = head(page_id, url or "", len(payload), digest, refers_to)
            for chunk, (count, data, so_far, running) in enumerate(chunks_of(payload, start, digest, refers_to is not None)):
                rows.append((part, record, chunk, count, data, so_far, running))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
            record += 1
    if rows:
        yield batch()


class _Reader:
    """Parses one record from its pieces."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.seen, self.payload, self.tail = hashlib.sha256(), 0, b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            top, _, rest = data.partition(END)
            lines = top.decode("utf-8", "surrogatepass").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            http, _, data = rest.partition(END)
            self.size = int(http.decode().rpartition("Content-Length: ")[2])
            self.block = int(self.fields["Content-Length"]) - len(http) - len(END)
        take = data[: self.block - self.payload]
        self.seen.update(take)
        self.payload += len(take)
        self.tail += data[len(take) :]

    def row(self) -> tuple:
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.tail != END or self.payload != self.block or kind == "response" and (self.seen.hexdigest() != digest or self.size != self.payload):
            raise ValueError(f"damaged record {self.fields['WARC-Record-ID']}")
        refers = self.fields.get("WARC-Refers-To")
        return _page(self.fields["WARC-Record-ID"]), self.size, digest, kind, _page(refers) if refers else None


def _read(batches: Batches) -> Batches:
    """Pieces of a record come one after the other."""
    reader = None
    for b in batches:
        rows = []
        for chunk, count, data, so_far, running in zip(*(b.column(c).to_pylist() for c in ("chunk", "chunks", "data", "payload_so_far", "digest_so_far")), strict=True):
            reader = _Reader() if chunk == 0 else reader
            reader.feed(data)
            if reader.payload != so_far or reader.seen.hexdigest() != running:
                raise ValueError("damaged chunk")
            if chunk == count - 1:
                rows.append(reader.row())
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat an earlier payload; `pages` has page_id, size, digest."""
    groups = pages.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows"))
    firsts = checkpointed(groups.where("rows > 1 and refers_to is not null").select("digest", "refers_to"))
    later = pages.select("page_id", "digest").join(gated(firsts), "digest").where("not (page_id <=> refers_to)")
    return checkpointed(later.select("page_id", "digest", "refers_to").distinct())


def write_archive(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record per row of `df` as a chunked record table.

    A null payload is the empty payload.  Of equal payloads of LEAST_REVISIT bytes or more the smallest identifier is
    the response and the others revisit it; rows that repeat that identifier and payload are responses too, with the
    same record name.  A row without an identifier may revisit but is never referred to.  A payload of any length is cut
    into chunk rows, and other columns than identifier, address and payload are not read.  An empty table gives an
    empty folder.
    """
    spark = df.sparkSession
    url = F.col(url_col) if url_col in df.columns else F.lit("")
    html = text_or_empty(payload_col)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), url.cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    sized = checkpointed(pages.select("page_id", "digest", F.octet_length("html").alias("size")))
    later = gated(revisits(sized).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"))
    rows = pages.join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")
    with batch_rows(spark, BATCH_PAGES):
        rows.mapInArrow(tidy(_write), RECORDS_DDL).write.option("compression", "zstd").parquet(folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, all digests verified.

    Records of one chunk are parsed where they lie; only the chunks of larger ones are brought together.
    """
    stored = spark.read.schema(RECORDS_DDL).parquet(folder)
    columns = ["part", "record", "chunk", "chunks", "data", "payload_so_far", "digest_so_far"]
    whole = stored.where("chunks = 1").select(columns).mapInArrow(tidy(_read), READ_DDL)
    cut = stored.where("chunks > 1").select(columns).repartition("part", "record").sortWithinPartitions("part", "record", "chunk").mapInArrow(tidy(_read), READ_DDL)
    return whole.union(cut)


def export_archives(spark: SparkSession, folder: str, target: str) -> int:
    """Write each part as a .warc file into a directory that driver and executors share; their number.

    Tasks write their own files, a chunk at a time, and each appears whole or not at all.
    """

    def run(batches: Batches) -> Batches:
        chunks = (x for b in batches for x in zip(b.column("part").to_pylist(), b.column("data"), strict=True))
        for part, some in groupby(chunks, key=lambda x: x[0]):
            write_whole(os.path.join(target, f"pages-{part:05d}.warc"), (data.as_py() for _, data in some))
            yield pa.RecordBatch.from_pydict({"files": pa.array([1], pa.int64())})

    rows = spark.read.schema(RECORDS_DDL).parquet(folder).select("part", "record", "chunk", "data")
    ordered = rows.repartition("part").sortWithinPartitions("part", "record", "chunk")
    with batch_rows(spark, BATCH_CHUNKS):
        return ordered.mapInArrow(tidy(run), "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def archive_round_trip(df: DataFrame) -> DataFrame:
    """Write a table of pages to archives in the shared folder and read them back; an empty table gives no rows.

    The archives are deleted once they are read.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/archive-{uuid4().hex}"
    write_archive(df, folder)
    found = checkpointed(read_archive(spark, folder), BATCH_CHUNKS)
    remove(spark, folder)
    return found

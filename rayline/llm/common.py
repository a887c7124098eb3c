"""Helpers shared by the operators: checkpointing, Arrow batches, size-gated joins, text rules."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.size import BROADCAST_ROWS as BROADCAST_ROWS, gated as gated

#: The white space of every word rule here, as a Java, DuckDB and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a function which reads whole texts is given at a time; Spark bounds the batches themselves by bytes.
TEXT_BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a folder of our own will do only if driver and executors are one process.
    """
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        home = spark.conf.get("spark.checkpoint.dir", None)
        if home is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(home or tempfile.mkdtemp(prefix="rayline-"))
        found = sc.getCheckpointDir()
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Make a folder in the shared store that is deleted when the driver ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)  # only what exists can be marked
    store.deleteOnExit(path)


def write_whole(path: str, pieces: Iterable[bytes]) -> None:
    """A file that appears under its name only when it is whole; writing it again changes nothing."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid4().hex}"
    with open(part, "wb") as f:
        f.writelines(pieces)
    os.replace(part, path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> Iterator[None]:
    """For the time of an action, have Spark hand at most `rows` rows at a time to Python functions.

    Frames that are returned without an action keep the session's own setting and Spark's bound of bytes a batch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame, rows: int = TEXT_BATCH_ROWS) -> DataFrame:
    """Cut the lineage with a reliable copy in the shared folder; `rows` bounds Arrow batches on the way."""
    shared_dir(df.sparkSession)
    with batch_rows(df.sparkSession, rows):
        return df.checkpoint(eager=True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores after it while `columns` has it; case does not count."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def long_column(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches], rows: int = TEXT_BATCH_ROWS) -> Callable[[Batches], Batches]:
    """Have a task's function see at most `rows` rows at a time, and give its memory back at the end.

    Workers stay, and idle ones should not hold memory.
    """

    def tidied(batches: Batches) -> Batches:
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied

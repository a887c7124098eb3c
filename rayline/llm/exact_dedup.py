"""Exact deduplication by content sort.

Sampled splitters range-partition the rows in content order, every partition is sorted externally by Spark, equal
texts become neighbours, and each row is compared in full with the row before it.  The head of a run of equals has
the smallest identifier.  Content order is (first code points, 64-bit hash, text, identifier): the splitters Spark
samples are then a few bytes each however long the texts are, and a group of copies of any size is spread over as
many partitions as it fills, because the identifier takes part in the split.  Runs that meet a partition's edge are
stitched in a second step through one small row per partition edge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, Batches, checkpointed, fresh, gated, long_column, text_or_empty, tidy

NO_ID = -(2**63)
PREFIX_CHARS = 24
WALKED = "doc_id long, keep_id long, group_size long, first boolean, text_sha256 string, edge boolean, part int"


def normalise(text: Column | str) -> Column:
    """Each run of white space becomes one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


class _Walk:
    """Walks rows in content order and closes runs of equal texts.

    Rows are held back only while the content key stays the same, as identifiers: a partition's share of one group.
    """

    def __init__(self, part: int) -> None:
        self.part, self.first_key, self.key, self.runs, self.out = part, None, None, [], []

    def add(self, key: tuple, digest: str, ids: np.ndarray, same: bool) -> None:
        if same:
            self.runs[-1][1].append(ids)
            return
        if key != self.key:
            self.flush(last=False)
            self.key = key
            self.first_key = self.first_key or key
        self.runs.append((digest, [ids]))

    def flush(self, last: bool) -> None:
        edge = last or self.key == self.first_key
        for digest, pieces in self.runs:
            self.out.append((digest, np.concatenate(pieces), edge))
        self.runs = []

    def batch(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        sizes = np.array([len(ids) for _, ids, _ in self.out])
        ids, heads = np.concatenate([ids for _, ids, _ in self.out]), np.array([ids[0] for _, ids, _ in self.out])
        first = np.zeros(len(ids), bool)
        first[np.cumsum(sizes) - sizes] = True
        spread = lambda values: pa.array(values).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        keep = np.repeat(heads, sizes)
        columns = [
            pa.array(ids, mask=ids == NO_ID),
            pa.array(keep, mask=keep == NO_ID),
            spread(sizes.astype(np.int64)),
            pa.array(first),
            spread([digest for digest, _, _ in self.out]),
            spread([edge for _, _, edge in self.out]),
            pa.array(np.full(len(ids), self.part, np.int32)),
        ]
        self.out = []
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "keep_id", "group_size", "first", "text_sha256", "edge", "part"])


def _walk(batches: Batches) -> Batches:
    walk, before = _Walk(TaskContext.get().partitionId()), None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        texts, ids = b.column("norm"), long_column(b.column("doc_id"), NO_ID)
        same = np.zeros(n, bool)
        same[0] = before is not None and texts[0].as_py() == before
        same[1:] = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        before = texts[n - 1].as_py()
        starts = np.flatnonzero(~same | (np.arange(n) == 0)).tolist()
        heads, hashes, digests = b.column("head").to_pylist(), b.column("hash").to_pylist(), b.column("digest")
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            walk.add((heads[s], hashes[s]), digests[s].as_py(), ids[s:e], bool(same[s]))
        if (done := walk.batch()) is not None:
            yield done
    walk.flush(last=True)
    if (done := walk.batch()) is not None:
        yield done


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[str], Column] = normalise) -> DataFrame:
    """Group rows by equal normalised text: (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    `keep_id` is the group's smallest identifier and `kept` marks the row that stays.  A null text is the empty
    text; empty texts are one group.  Null identifiers sort after all others, so such a row stays only if its group
    has no identifier (keep_id is then null).  Rows that repeat an identifier and a text are one group, of which one
    row stays.  An empty table gives no rows.  Only the two named columns are read, whatever else the table holds.
    """
    rows = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), normal(text_col).alias("norm"))
        .select("doc_id", "norm", F.substring("norm", 1, PREFIX_CHARS).alias("head"), F.xxhash64("norm").alias("hash"))
        .repartitionByRange("head", "hash", F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions("head", "hash", "norm", F.col("doc_id").asc_nulls_last())
        .withColumn("digest", F.sha2("norm", 256))
    )
    walked = checkpointed(rows.mapInArrow(tidy(_walk), WALKED))
    # One row for each run at a partition's edge: two a partition, whatever the data.
    edges = (
        walked.where("edge and first")
        .groupBy("text_sha256")
        .agg(F.sum("group_size").alias("all_size"), F.min("keep_id").alias("all_keep"), F.min("part").alias("all_part"))
        .withColumn("at_edge", F.lit(True))
    )
    joined = walked.withColumn("at_edge", F.col("edge")).join(F.broadcast(edges), ["text_sha256", "at_edge"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("edge"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("edge"), F.col("all_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("first") & (~F.col("edge") | (F.col("part") == F.col("all_part")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that exact_dedup drops, all columns kept whatever their names.

    Null and empty texts are equal; of a group without identifiers one row stays, and so does one of rows that repeat
    both identifier and text.  Texts of any length are compared whole.  An empty table gives no rows.
    """
    mark, gone_id, gone_mark = fresh(docs.columns, "mark", "gone_id", "gone_mark")
    lost = checkpointed(exact_dedup(docs, id_col, text_col)).where("not kept")
    named = lambda df: checkpointed(df.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_mark)).distinct())
    same = lambda df: df[id_col].cast("long").eqNullSafe(F.col(gone_id)) & (df[mark] == F.col(gone_mark))
    marked = docs.withColumn(mark, F.sha2(normalise(text_col), 256))
    left = marked.join(gated(named(lost.where("not (doc_id <=> keep_id)"))), same(marked), "left_anti")
    alike = named(lost.where("doc_id <=> keep_id"))
    if alike.head(1):  # rows that repeat both identifier and text
        alike = gated(alike)
        left = left.join(alike, same(left), "left_anti").union(left.join(alike, same(left), "left_semi").dropDuplicates([id_col, mark]))
    return left.drop(mark)

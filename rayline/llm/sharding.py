"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, gated, text_or_empty


def bid(key: Column, shard: int, weight: float) -> Column:
    """A shard's bid for a key: an exponential draw of rate `weight`; the least bid wins the key.

    A bid depends on the key and its shard alone, so one more shard takes the keys it wins and moves no other.
    """
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return F.struct((-F.log(draw) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard"))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The struct (bid, shard) of the shard that wins a key; equal bids go to the lower number."""
    bids = [bid(key, i, w) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*bids))


def slots(placed: DataFrame, shard_col: str = "shard") -> DataFrame:
    """Add `slot`, gapless from 0 in each shard, to a checkpointed table.

    Rows are numbered within (input partition, shard) and offset by the counts of earlier partitions: no shard is
    ever gathered in one task.
    """
    rows = placed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy("_part", shard_col).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(shard_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(counts.select("_part", shard_col, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    within = F.row_number().over(Window.partitionBy("_part", shard_col).orderBy("_row"))
    numbered = rows.withColumn("_within", within).join(gated(offsets), ["_part", shard_col])
    return numbered.withColumn("slot", F.col("_offset") + F.col("_within") - 1).drop("_row", "_part", "_rows", "_offset", "_within")


def rendezvous_shards(df: DataFrame, shards: int | Sequence[float] = 24, added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of `df`.

    `shards` is a number of equal shards or a list of weights; `grown_shard` is the shard with one more of weight
    `added`.  The law is `key`: identifier and weights decide alone.  Rows that repeat an identifier, or have none,
    go to one shard each time; they have slots of their own.  A null text counts as no bytes.  An empty table gives
    no rows, and no other column is read.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    key = F.col("doc_id").cast("string")
    text = text_or_empty(text_col)
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sized.withColumn("_won", winner(key, weights)).withColumn("_grown", F.least(F.col("_won"), bid(key, len(weights), added)))
    placed = checkpointed(placed.select("doc_id", "size", "text_crc32", F.col("_won.shard").alias("shard"), F.col("_grown.shard").alias("grown_shard")))
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Mixing sources to target weights, with DataFrame expressions only.

Documents of a source are dealt into blocks by hash.  A source's target is met by whole copies of all its blocks plus
one more copy of some of them, chosen in permuted order.  Where blocks are too coarse to come within SHARE of the
target, one that does not fit is dealt into blocks of its own by another hash, and so on; the last ones hold a single
identifier, so that what is missing then is less than that identifier's documents.  The copies are then dealt to output
shards by a splitting tree: at each node half of the shards draw their share of the node's copies without replacement,
which makes the numbers per source multivariate hypergeometric and their sums exact.  Each shard draws that many of each
source's permuted blocks, disjoint from all others', and is shuffled locally by a hash.  A round of splitting adds
MOST_BLOCKS blocks, or FEW_BLOCKS for each source if these are more, whatever the number of documents; tables of blocks
and sources are broadcast while their counted rows are few, and beyond that documents are shuffled to them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, WORD, checkpointed, fresh, gated, text_or_empty

#: Blocks of one source at most and at least, and of all sources together; each time that blocks are split.
BLOCKS, FEW_BLOCKS, MOST_BLOCKS = 512, 16, 65_536
#: Blocks are split until a source is this near to its target.
SHARE = 0.001
#: Copies that one splitting tree deals.
TREE_COPIES = 4 * MOST_BLOCKS


def word_count(text: Column | str) -> Column:
    """Words between white space, without building them."""
    return F.length(F.regexp_replace(F.regexp_replace(text_or_empty(text), WORD, "w"), SPACE, "")).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Add `target` to (source, source_size): shares of the sum by weight, none above cap times its size.

    Weights repeat over sources in code-point order, null last.  With sources in order of cap / weight, the ones
    that stop at their cap come first; what these leave is shared by weight among the rest.  One task sorts the sources,
    a name and a number each: this step grows with their number only.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1
    all_of = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    top = F.col("source_size") * float(cap)
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("ratio", top / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_of).cast("double"))
        .withColumn("stopped_before", F.coalesce(F.sum(top).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("stopped_before")) / F.sum("weight").over(rest))
        .withColumn("stops", F.col("level") >= F.col("ratio"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("stops"), top).otherwise(0.0)).over(all_of))
        .withColumn("open", F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(all_of))
        .withColumn("target", F.when(F.col("stops"), top).otherwise(F.col("weight") * F.col("left") / F.nullif("open", F.lit(0.0))))
        .select("source", "source_size", "target")
    )


def _block(id_col: Column, blocks: int, seed: int, step: int = 0) -> Column:
    """The block of an identifier among those of one step; numbers differ between steps."""
    key = F.xxhash64(F.lit(seed), F.lit(step), id_col) if step else F.xxhash64(F.lit(seed), id_col)
    return (F.lit(step * BLOCKS) + F.pmod(key, F.lit(blocks))).cast("int")


def _blocks_each(sources: int) -> int:
    return max(FEW_BLOCKS, min(BLOCKS, MOST_BLOCKS // max(1, sources)))


@dataclass(frozen=True)
class Blocks:
    """How documents are dealt: the number of blocks at each step, and (source, path), the blocks split on the way."""

    counts: list[int]
    splits: DataFrame | None
    seed: int

    def of(self, df: DataFrame, id_col: str, source_col: str, name: str) -> DataFrame:
        """Add the block of each row as `name`."""
        block = _block(df[id_col], self.counts[0], self.seed)
        if self.splits is None:
            return df.withColumn(name, block)
        source, path = fresh(df.columns, "split_source", "path")
        paths = gated(self.splits.select(F.col("source").alias(source), F.col("path").alias(path)))
        # By source and first block, so that a shuffle spreads a large source.
        joined = df.join(paths, df[source_col].eqNullSafe(F.col(source)) & (block == F.get(path, F.lit(0))), "left")
        for step, count in enumerate(self.counts[1:], 1):
            block = F.when(F.get(path, F.lit(step - 1)) == block, _block(df[id_col], count, self.seed, step)).otherwise(block)
        return joined.select(*[df[c] for c in df.columns], block.alias(name))


def _fill(inside: DataFrame, state: DataFrame, step: int, seed: int) -> DataFrame:
    """One step for each source of `state`: take blocks in permuted order while they fit `rest`, and say which to split.

    Adds `blocks`, `picked` and `split` (null: done); `miss`, `last`, `at` and `whole` describe the nearest fill of all
    steps so far: what was picked up to step `at`, and block `last`, which is `whole` if it was split thereafter.
    """
    sums = inside.groupBy("source", "block").agg(F.sum("size").alias("size"), (F.min("doc_key") < F.max("doc_key")).alias("many"))
    mine = sums.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "source", "block").alias("key"), "block", "size", "many"))).alias("blocks"))
    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<int>").alias("picked"))
    take = lambda acc, b: F.when(b["size"] <= acc["rest"], F.struct((acc["rest"] - b["size"]).alias("rest"), F.array_append(acc["picked"], b["block"]).alias("picked"))).otherwise(acc)
    found = mine.withColumnRenamed("source", "s").join(gated(state), F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("filled", F.aggregate("blocks", start, take))
    found = found.withColumn("rest", F.col("filled.rest")).withColumn("picked", F.col("filled.picked"))
    found = found.withColumn("others", F.filter("blocks", lambda b: ~F.array_contains(F.col("picked"), b["block"])))
    # One more block if that comes nearer than the gap that is left.
    gap = F.col("rest")
    nearer = F.filter("others", lambda b: b["size"] < 2 * gap)
    found = found.withColumn("near", F.array_min(F.transform(nearer, lambda b: F.struct(F.abs(b["size"] - gap).alias("miss"), b["block"].alias("block")))))
    found = found.withColumn("now", F.coalesce("near.miss", gap)).withColumn("better", F.col("miss").isNull() | (F.col("now") < F.col("miss")))
    # The smallest block that does not fit and has more than one identifier: its documents are the smallest, too.
    inner = F.array_min(F.transform(F.filter("others", lambda b: b["many"]), lambda b: F.struct(b["size"], b["block"])))["block"]
    found = found.withColumn("split", F.when(F.least("now", "miss") > SHARE * F.col("target"), inner))
    newer = lambda value, old: F.when(F.col("better"), value).otherwise(F.col(old)).alias(old)
    last = F.coalesce(F.col("near.block"), F.lit(-1))
    return found.select(
        "source", "target", "full", "rest", "path", "blocks", "picked", "split",
        newer(F.col("now"), "miss"), newer(last, "last"), newer(F.lit(step), "at"), newer(F.coalesce(last == F.col("split"), F.lit(False)), "whole"),
    )


def _copies(docs: DataFrame, aims: DataFrame, cap: int, seed: int, sources: int) -> tuple[DataFrame, Blocks]:
    """(source, block, copies): full copies of all blocks, and one more of those that fill the rest of the target."""
    full = F.least(F.lit(cap), F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))).cast("int")
    rest = F.when(F.col("full") < cap, F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0))).otherwise(F.lit(-1.0))
    state = aims.withColumn("full", full).withColumn("rest", rest).select(
        "source", "target", "full", "rest", F.array().cast("array<int>").alias("path"), F.lit(None).cast("double").alias("miss"),
        F.lit(-1).alias("last"), F.lit(0).alias("at"), F.lit(False).alias("whole"),
    )
    counts = [_blocks_each(sources)]
    inside = docs.withColumn("doc_key", F.xxhash64("doc_id")).withColumn("block", _block(F.col("doc_id"), counts[0], seed))
    leaves, done = None, None
    while True:
        step = len(counts) - 1
        found = checkpointed(_fill(inside, state, step, seed))
        cells = found.select("source", "split", F.explode(F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), F.array_contains("picked", b["block"]).alias("picked")))).alias("b"))
        cells = cells.where(~F.col("b.block").eqNullSafe(F.col("split"))).select("source", "b.*", F.lit(step).alias("step"))
        ended = found.where("split is null").select("source", "full", "path", "last", "at", "whole")
        leaves, done = (cells, ended) if leaves is None else (leaves.union(cells), done.union(ended))
        going = found.where("split is not null")
        if not (n := going.count()):
            break
        state = going.select("source", "target", "full", "rest", F.array_append("path", F.col("split")).alias("path"), "miss", "last", "at", "whole")
        chosen = gated(going.select(F.col("source").alias("s"), "split"))
        counts.append(_blocks_each(n))
        inside = inside.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("split"))).drop("s", "split")
        inside = inside.withColumn("block", _block(F.col("doc_id"), counts[-1], seed, step + 1))
    # Blocks of later steps than the nearest fill are all parts of the block that was split at its step.
    extra = F.when(F.col("step") <= F.col("at"), F.col("picked") | (F.col("block") == F.col("last"))).otherwise(F.col("whole")).cast("int")
    ends = gated(done.withColumnRenamed("source", "s"))
    copies = leaves.join(ends, F.col("source").eqNullSafe(F.col("s"))).select("source", "block", (F.col("full") + extra).alias("copies"))
    splits = done.where(F.size("path") > 0).select("source", "path") if len(counts) > 1 else None
    return checkpointed(copies), Blocks(counts, splits, seed)


def _deal(copies: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, copies, shards): the output shard of each copy, by the splitting tree, or one for each so many."""
    trees = 1 + int(copies.agg(F.sum("copies")).first()[0] or 0) // TREE_COPIES
    units = copies.where("copies > 0").select("source", "block", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    tree = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "block", "copy"), F.lit(trees))
    node = units.select("source", tree.alias("tree"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.xxhash64(F.lit(seed + 1), "source", "block", "copy").alias("key"))
    for level in range((shards - 1).bit_length()):
        here = Window.partitionBy("tree", "lo", "hi")
        rank = F.row_number().over(here.orderBy(F.xxhash64(F.lit(level), "key"), "key"))
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        share = F.round(F.count("*").over(here) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        goes_left = (F.col("hi") - F.col("lo") > 1) & (rank <= share)
        node = node.select("source", "tree", "key", "lo", "hi", mid.alias("mid"), goes_left.alias("goes_left"))
        one = F.col("hi") - F.col("lo") <= 1
        node = node.select("source", "tree", "key", F.when(one | F.col("goes_left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(one | ~F.col("goes_left"), F.col("hi")).otherwise(F.col("mid")).alias("hi"))
    quotas = node.groupBy("source", F.col("lo").alias("shard")).agg(F.count("*").alias("quota"))
    ends = quotas.select("source", "shard", F.sum("quota").over(Window.partitionBy("source").orderBy("shard")).alias("end"), "quota")
    drawn = units.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block", "copy"), "block", "copy")))
    ends = gated(checkpointed(ends.withColumnRenamed("source", "s")))
    placed = drawn.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("turn") <= F.col("end")) & (F.col("turn") > F.col("end") - F.col("quota"))).drop("s")
    dealt = placed.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))  # cap entries at most
    dealt = dealt.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    return copies.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").select("source", "block", "copies", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def plan(df: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, Blocks]:
    """What a mix takes: the documents' sizes, the table of blocks to take, and how documents are dealt into blocks.

    The table (source, block, source_size, target, copies, shards) is checkpointed.
    """
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    docs = checkpointed(sized)
    sources = checkpointed(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = checkpointed(targets(sources, weights, cap))
    copies, blocks = _copies(docs, aims, cap, seed, sources.count())
    table = _deal(copies, shards, seed).withColumnRenamed("source", "s")
    table = checkpointed(table.join(gated(aims), F.col("s").eqNullSafe(F.col("source"))).drop("s"))
    return blocks.of(docs, "doc_id", "source", "block"), table, blocks


def mix(df: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, shards: int = 8, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), one row per row of `df`; equal on every run.

    `size` counts words, 0 for a null or empty text; the target is the source's, in words; `taken` is the size times
    the copies the mix takes, and `shards` the output shard of each copy.  A null source is a source of its own, the
    last.  Rows are dealt by their identifier, so rows that repeat one (or have none) share a block and its copies.
    An empty table gives no rows.  Targets are 0 where no document has a word.
    """
    docs, table, _ = plan(df, weights, cap, shards, seed)
    table = gated(table.withColumnRenamed("source", "s").withColumnRenamed("block", "b"))
    joined = docs.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return joined.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "shards")


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str | None = None
) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, in the shards the tree dealt it to.

    Each output partition holds rows of one shard, in order of a hash; a shard has as many partitions as its share of
    spark.sql.shuffle.partitions, and partitions count on from shard to shard.  All columns stay whatever their names;
    `shard_col` adds the shard.  Null sources, identifiers and texts are as in mix(); a text of any length is one row,
    and an empty table gives no rows.
    """
    columns = docs.columns
    _, table, blocks = plan(docs, weights, cap, shards, seed, id_col, text_col, source_col)
    s, b, dealt, block, copy, shard, order = fresh([*columns, shard_col or ""], "s", "b", "dealt", "block", "copy", "shard", "order")
    table = gated(table.select(F.col("source").alias(s), F.col("block").alias(b), F.col("shards").alias(dealt)))
    placed = blocks.of(docs, id_col, source_col, block)
    copies = placed.join(table, placed[source_col].eqNullSafe(F.col(s)) & (F.col(block) == F.col(b)))
    copies = copies.select(*columns, F.posexplode(dealt).alias(copy, shard)).withColumn(order, F.xxhash64(F.lit(seed), shard, id_col, text_col, copy))
    each = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    spread = copies.repartitionById(shards * each, (F.col(shard) * each + F.pmod(F.col(order), F.lit(each))).cast("int")).sortWithinPartitions(order)
    return spread.select(*columns, *([F.col(shard).alias(shard_col)] if shard_col else []))

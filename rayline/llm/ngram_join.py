"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Rows of the incidence matrix are documents (one per set of n-grams), columns are 64-bit n-gram hashes.  The product
of the matrix with its transpose holds the overlap of each pair; most of it is never formed:

* Columns are ordered by hash.  Two sets that reach the threshold share at least k of the first
  ``size - least overlap + k`` columns of each, so only these leading columns are looked at first.  A row survives if
  enough of its leading columns occur in another row too; the bound follows from its size alone.
* Surviving rows are cut into families, connected by shared leading columns; the most frequent of a row's columns may
  be left out here, by the same count.  Rows of different families have no product worth forming.
* A family is multiplied in blocks of bounded size.  A larger one is cut by size class and hash into parts, and two
  parts are multiplied if their size classes can reach the threshold.  Where there are many parts, this has two steps.
  First each part is multiplied with itself and with the first part of its class, which settles groups of alike rows at
  a cost in proportion to them: rows of the family's largest group need no product with each other any more.  Then each
  part sends another only those rows that share one of the columns that made the family with an open row there.
* A block's overlaps are accumulated column by column, pairs below the bound given by their sizes are discarded, and
  what leaves the task is a spanning star of each linked group, never the pairs.

All of it is exact: no cap on partners, candidates or column frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, Batches, as_bytes, checkpointed, fresh, gated, text_or_empty, tidy
from .components import components

#: One in so many of a set's shingles is looked at beyond what one shared leading column would need.
SPARE = 10
#: Known words a worker remembers before it starts again.
WORDS_KEPT = 400_000
#: Bounds of one side of a block: rows, and entries of these rows.
BLOCK_ROWS, BLOCK_ENTRIES = 1024, 2_000_000
#: A family of more parts than this is multiplied in two steps.
MANY_PARTS = 32
#: A digest of more rows than this is never joined by a shuffle.
HOT_ROWS = 100_000
#: A column met by more rows of a block than this is multiplied densely.
DENSE_FROM = 12

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Law:
    """Link two sets of `words`-word shingles when den * overlap >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def least(self, n: int) -> int:
        """The least overlap that a set of n shingles needs with any other."""
        return -(-self.num * n // self.den)

    def spare(self, n: int) -> int:
        """How many leading columns a set of n shingles has to share with a partner of its own size."""
        return n // SPARE + 1

    def lead(self, n: int) -> int:
        return min(n, n - self.least(n) + self.spare(n))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a UTF-8 text, A-Z lower-cased; fewer words make one shingle."""
    found = text.lower().split()  # bytes: ASCII letters and the six ASCII white-space characters only
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(k, len(ids))
    n = len(ids) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n]) * _MIX
        h ^= h >> np.uint64(32)
    h *= _MIX2
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(law: Law, whole: bool, marked: bool = False):
    """Per document: its id, set size, set digest (null: no words), the leading columns or the whole set, and its mark."""

    def run(batches: Batches) -> Batches:
        words = _Words()
        for b in batches:
            sets = [shingle_set(x, law.words, words) for x in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    _lists(sets if whole else [x[: law.lead(len(x))] for x in sets]),
                    *([b.column("mark")] if marked else []),
                ],
                ["doc_id", "n", "digest", "cols", *(["mark"] if marked else [])],
            )

    return run


SETS = "doc_id long, n long, digest binary, cols array<long>"


def overlaps(sets: list[np.ndarray], left: int = 0) -> np.ndarray:
    """The product of the incidence matrix of `sets` with its transpose: overlap counts, zero on the diagonal.

    With `left`, only the products of the first so many sets with the others are formed.
    """
    m = len(sets)
    counts = np.zeros((m, m), np.int32)
    columns = np.concatenate(sets)
    rows = np.repeat(np.arange(m, dtype=np.int64), [len(x) for x in sets])
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1]]))
    df = np.diff(np.concatenate([starts, [len(columns)]]))
    flat = counts.reshape(-1)
    for d in range(2, min(DENSE_FROM, m) + 1):
        postings = rows[starts[df == d][:, None] + np.arange(d)]  # rows ascend
        for i in range(d):
            for j in range(i + 1, d):
                a, b = postings[:, i], postings[:, j]
                if left:
                    across = (a < left) & (b >= left)
                    a, b = a[across], b[across]
                np.add.at(flat, a * m + b, 1)
    dense, step = np.flatnonzero(df > DENSE_FROM), 4096
    for at in range(0, len(dense), step):
        some = dense[at : at + step]
        x = np.zeros((m, len(some)), np.float32)
        x[np.concatenate([rows[starts[c] : starts[c] + df[c]] for c in some]), np.repeat(np.arange(len(some)), df[some])] = 1
        if left:
            counts[:left, left:] += np.rint(x[:left] @ x[left:].T).astype(np.int32)
        else:
            counts += np.triu(np.rint(x @ x.T), 1).astype(np.int32)
    upper = np.triu(counts, 1)
    return upper + upper.T


def linked(sets: list[np.ndarray], law: Law, left: int = 0) -> np.ndarray:
    """Per set the index of the first set of its linked group; with `left`, by links of the first so many with the others."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    counts = overlaps(sets, left).astype(np.int64)
    links = (counts > 0) & ((law.den + law.num) * counts >= law.num * (sizes[:, None] + sizes))
    np.fill_diagonal(links, True)
    label = np.arange(m)
    while True:
        new = np.where(links, label, m).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _products(law: Law):
    """Rows come sorted by block and side: for each block, star edges of its linked groups.

    A block of a part with itself has one side; of others the sides are multiplied with each other.
    """

    def run(batches: Batches) -> Batches:
        at, nodes, sets, left = None, [], [], 0

        def stars():
            within = at[1] == at[2]
            if len(sets) < 2 or not within and left in (0, len(sets)):
                return None
            label = linked(sets, law, 0 if within else left)
            ids = np.array(nodes)
            out = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[label[out]])], ["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("family", "left", "right")), strict=True))
            cols = b.column("cols")
            flat, ends = cols.values.to_numpy().view(np.uint64), cols.offsets.to_numpy()
            for i, (key, node, side) in enumerate(zip(keys, b.column("node").to_pylist(), b.column("side").to_pylist(), strict=True)):
                if key != at:
                    if (found := stars() if sets else None) is not None:
                        yield found
                    at, nodes, sets, left = key, [], [], 0
                nodes.append(node)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
                left += side == 0
        if (found := stars() if sets else None) is not None:
            yield found

    return run


def _multiplied(sets: DataFrame, blocks: DataFrame, law: Law) -> DataFrame:
    """(a, b): star edges of the linked groups of all blocks (node, family, left, right, side)."""
    rows = sets.join(blocks, "node").repartition("family", "left", "right").sortWithinPartitions("family", "left", "right", "side")
    return rows.select("family", "left", "right", "side", "node", "cols").mapInArrow(tidy(_products(law)), "a long, b long")


def _parts(rows: str, entries: str) -> Column:
    return F.ceil(F.greatest(F.col(rows) / F.lit(BLOCK_ROWS), F.col(entries) / F.lit(BLOCK_ENTRIES))).cast("long")


def _part(size_class: Column, number: Column) -> Column:
    """A part's name keeps the order of class and number, so that both sides of a block name it alike."""
    return size_class * F.lit(1 << 40) + number


def _placed(members: DataFrame, law: Law) -> tuple[DataFrame, DataFrame]:
    """Members (node, family, class, me, total) of families beyond the bounds, cut by size class and hash, and parts (family, c, other).

    Classes are as wide as the threshold, so only rows of the same or of neighbouring ones can link.  `total` counts
    the family's parts.  Tables of classes and of parts are broadcast if few, so that the rows of a family do not meet
    in one task.
    """
    wide = math.log(law.den / law.num) * (1 + 1e-6)  # a little wider, so that rounding can't part a pair by two classes
    members = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(wide)).cast("long"))
    per_class = members.groupBy("family", "class").agg(F.count("*").alias("rows"), F.sum("n").alias("entries"))
    per_class = checkpointed(per_class.select("family", "class", _parts("rows", "entries").alias("parts")))
    total = per_class.groupBy("family").agg(F.sum("parts").alias("total"))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = members.join(gated(checkpointed(per_class.join(total, "family"))), ["family", "class"])
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i")
    parts = per_class.select("family", F.col("class").alias("c"), numbers).select("family", "c", _part(F.col("c"), F.col("i")).alias("other"))
    return checkpointed(placed.select("node", "family", "class", _part(F.col("class"), own).alias("me"), "total")), gated(checkpointed(parts))


#: Conditions on a row (class, me) and a part (c, other): whether rows of the two parts may link, whether a part is the
#: first of its class, and what the first blocks of many multiply.
def _near() -> Column:
    return F.abs(F.col("class") - F.col("c")) <= 1


def _first(size_class: str, part: str) -> Column:
    return F.col(part) == _part(F.col(size_class), F.lit(0).cast("long"))


def _by_first_blocks() -> Column:
    mine, its = _first("class", "me"), _first("c", "other")
    return F.when(F.col("class") == F.col("c"), mine | its).otherwise(mine & its) | (F.col("me") == F.col("other"))


def _sided(sent: DataFrame) -> DataFrame:
    """Blocks of rows (node, family, me) that are sent to the part `other`."""
    return sent.select("node", "family", F.least("me", "other").alias("left"), F.greatest("me", "other").alias("right"), (F.col("me") > F.col("other")).cast("int").alias("side"))


def _first_blocks(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """Each part with itself and with the first part of its class, and the first parts of neighbouring classes."""
    first = _part(F.col("class"), F.lit(0).cast("long"))
    later = placed.where(~_first("class", "me"))
    own = _sided(placed.withColumn("other", F.col("me"))).union(_sided(later.withColumn("other", first)))
    leads = placed.where(_first("class", "me")).join(parts, "family").where(_near() & (F.col("me") != F.col("other")) & _by_first_blocks())
    return own.union(_sided(leads))


def _open_blocks(placed: DataFrame, parts: DataFrame, groups: DataFrame, columns: DataFrame) -> DataFrame:
    """The other products: blocks of rows that share one of `columns` with a row of another part.

    Rows of a family's largest group so far are settled among themselves, so they are only sent to parts in which
    a row is open.  A family of one group has no open row.  A row with a column that is met in most parts is sent to
    all; others go where their columns are met with an open row.
    """
    labelled = placed.join(groups.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("family", "label").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("rows", "label"))["label"].alias("most"), F.count("*").alias("labels")).where("labels > 1")
    is_open = F.col("label") != F.col("most")
    rows = checkpointed(labelled.join(gated(checkpointed(largest)), "family").select("node", "family", "class", "me", "total", is_open.alias("open")))
    entries = checkpointed(columns.join(rows, "node").select("family", "h", "node", "class", "me", "total", "open"))
    met = entries.groupBy("family", "h", F.col("class").alias("c"), F.col("me").alias("other")).agg(F.max("open").alias("any_open"), F.first("total").alias("total"))
    # A column met in one part only, or by settled rows only, makes no block; of one met in most parts no list is made.
    per_column = met.groupBy("family", "h").agg(F.count("*").alias("parts"), F.max("any_open").alias("some"), F.first("total").alias("total"))
    per_column = checkpointed(per_column.where("parts > 1 and some").select("family", "h", (2 * F.col("parts") > F.col("total")).alias("most")))
    wide = checkpointed(entries.join(gated(per_column.where("most")), ["family", "h"]).select("node").distinct())
    listed = checkpointed(met.join(gated(per_column.where("not most")), ["family", "h"]).select("family", "h", "c", "other", "any_open"))
    fit = _near() & ~_by_first_blocks() & (F.col("open") | F.col("any_open"))
    narrow = entries.join(gated(wide), "node", "left_anti").join(gated(listed), ["family", "h"]).where(fit).select("node", "family", "me", "other").distinct()
    opened = rows.where("open").select("family", F.col("me").alias("other")).distinct().withColumn("any_open", F.lit(True))
    known = checkpointed(parts.join(opened, ["family", "other"], "left").select("family", "c", "other", F.coalesce("any_open", F.lit(False)).alias("any_open")))
    everywhere = rows.join(gated(wide), "node").join(gated(known), "family").where(fit).select("node", "family", "me", "other")
    return _sided(narrow.union(everywhere))


def _groups(members: DataFrame, columns: DataFrame, sets_of: Callable[[DataFrame], DataFrame], law: Law) -> DataFrame:
    """(node, label) of the linked members.

    `members` has node, n, family, digest and head, `columns` node and h; `sets_of` some members gives their node and cols.
    """
    sets = sets_of(members)
    whole = lambda df: df.select("node", "family", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(0).alias("side"))
    per_family = members.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("entries"))
    large = checkpointed(per_family.where(_parts("rows", "entries") > 1).select("family"))
    if not large.head(1):
        return components(_multiplied(sets, whole(members), law))
    large = gated(large)
    placed, parts = _placed(members.join(large, "family", "left_semi"), law)
    few = placed.where(F.col("total") <= MANY_PARTS).join(parts, "family").where(_near())
    blocks = whole(members.join(large, "family", "left_anti")).union(_sided(few))
    many = placed.where(F.col("total") > MANY_PARTS)
    if not many.head(1):
        return components(_multiplied(sets, blocks, law))
    edges = checkpointed(_multiplied(sets, blocks.union(_first_blocks(many, parts)), law))
    more = checkpointed(_open_blocks(many, parts, components(edges), columns))
    if not more.head(1):
        return components(edges)
    # Whole sets are made again, and sent, only of the rows that the second step multiplies.
    again = checkpointed(members.join(gated(checkpointed(more.select("node").distinct())), "node", "left_semi"))
    return components(edges.union(_multiplied(sets_of(again), more, law)))


def jaccard_components(df: DataFrame, law: Law = Law(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Shingles are over words between white space, A-Z lower-cased; a text of fewer words is one shingle.  Texts
    without words, and null texts, have an empty set and link with nothing: their component is their own identifier.
    Rows whose sets are equal always link.  A null identifier takes part in links but never names a component unless
    all of a component's identifiers are null.  Repeated rows are equal sets.  An empty table gives no rows, and
    other columns are not read.
    """
    return _labelled(df, law, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _mark(text_col: str) -> Column:
    """The text's digest: with the identifier it names rows that are judged alike."""
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def _labelled(df: DataFrame, law: Law, id_col: str, text_col: str, marked: bool = False) -> DataFrame:
    """The rows of jaccard_components(); `marked` adds their mark and group, the component's key (null: no words).

    Where identifiers repeat, several groups may have one component_id.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    extra = ["mark"] if marked else []
    read = texts.withColumn("mark", _mark("text")) if marked else texts
    docs = checkpointed(read.mapInArrow(tidy(_sets(law, False, marked)), SETS + ", mark binary" * marked).withColumn("row", F.monotonically_increasing_id()))

    # Rows that share enough of their leading columns with any other row.  Of these columns, all but the last
    # `shared - 1` in order of frequency suffice: partners share one of them at least, and frequent columns stay out.
    entries = docs.select("row", F.explode("cols").alias("h"))
    # Columns are counted where they meet, by a window: a table of counts would be shuffled besides the entries.
    repeated = entries.withColumn("rows", F.count("*").over(Window.partitionBy("h"))).where("rows > 1")
    met = repeated.groupBy("row").agg(F.collect_list(F.struct("rows", "h")).alias("met"))
    shared = F.floor(F.ceil(F.col("n") * law.num / law.den) / SPARE).cast("int") + 1
    small = docs.select("row", "doc_id", "n", "digest")
    surviving = small.join(met, "row").where(F.size("met") >= shared)
    rare = F.slice(F.sort_array("met"), F.lit(1), F.size("met") - shared + 1)["h"]
    # One row stands for all rows of an equal set.
    alike = surviving.select("doc_id", "n", "digest", rare.alias("rare")).groupBy("digest")
    heads = checkpointed(alike.agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("rare").alias("rare")).withColumn("node", F.xxhash64("digest")))

    columns = heads.select("node", F.explode("rare").alias("h"))
    centres = columns.groupBy("h").agg(F.min("node").alias("centre"), F.count("*").alias("rows")).where("rows > 1").select("h", "centre")
    families = components(columns.join(centres, "h").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    members = checkpointed(heads.select("node", "n", "digest", "head").join(families.select("node", F.col("label").alias("family")), "node"))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = gated(some.select(F.col("head").alias("_head")).distinct())
        whole = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("_head")), "left_semi").mapInArrow(tidy(_sets(law, whole=True)), SETS)
        return whole.where("digest is not null").join(some.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "cols")

    groups = _groups(members, columns, sets_of, law)

    # Components of sets, named by the smallest identifier of all rows that have one of the sets.  A set of one row
    # without links has a component of its own and need not be named.
    classes = small.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    labels = heads.select("digest", "node").join(groups, "node").select("digest", "label")
    named = classes.join(labels, "digest", "left").where("rows > 1 or label is not null")
    lows = named.where("label is not null").groupBy("label").agg(F.min("low").alias("label_low"))
    named = named.join(lows, "label", "left").select("digest", "rows", F.coalesce("label_low", "low").alias("component"), F.coalesce("label", F.xxhash64("digest")).alias("label"))
    found = _by_digest(docs.select("row", "doc_id", "n", "digest", *extra), checkpointed(named))
    empty = F.col("digest").isNull()
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty | F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), *extra,
        F.when(~empty, F.coalesce("label", F.xxhash64("digest"))).alias("group"),
    )


def _by_digest(docs: DataFrame, named: DataFrame) -> DataFrame:
    """`docs` with `component` and `label` of their digests, where `named` (digest, rows, component, label) has these.

    A table of few digests is broadcast.  Beyond that digests of many rows are, and rows that have one of these or none
    are spread by their numbers, so that no key of the shuffle has more than HOT_ROWS rows.
    """
    if named.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(named.drop("rows")), "digest", "left")
    name = lambda prefix: [F.col(c).alias(prefix + c) for c in ("digest", "component", "label")]
    hot = gated(checkpointed(named.where(F.col("rows") > HOT_ROWS).select(*name("hot_"))))
    first = docs.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    apart = F.col("hot_digest").isNotNull() | F.col("digest").isNull()
    first = first.withColumn("key", F.when(apart, F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary")).otherwise(F.col("digest")))
    rest = named.where(F.col("rows") <= HOT_ROWS).select(*name("cold_"))
    both = first.join(rest, F.col("key") == F.col("cold_digest"), "left")
    return both.withColumns({c: F.coalesce("hot_" + c, "cold_" + c) for c in ("component", "label")})


def drop_near_copies(docs: DataFrame, law: Law = Law(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, the one of its smallest identifier; all columns kept.

    Rows without an identifier stay, as nothing can name them; so do null and empty texts and others without words.
    Rows are told apart by identifier and text: of a component's rows that share its smallest identifier, one stays
    (the one whose text has the smallest digest, and of rows equal in both any one).  A text of any length is one set.
    An empty table gives no rows, and other columns stay whatever their names.
    """
    found = checkpointed(_labelled(docs, law, id_col, text_col, marked=True))
    gone = found.where("doc_id <> component_id").select("doc_id", "mark")
    firsts = found.where("doc_id = component_id and group is not null").groupBy("group", "doc_id").agg(F.count("*").alias("rows"), F.min("mark").alias("first"))
    firsts = checkpointed(firsts.where("rows > 1").select(F.col("group").alias("first_group"), "first"))
    among = found.where("doc_id = component_id").join(gated(firsts), F.col("group") == F.col("first_group"))
    more = among.where("mark <> first").select("doc_id", "mark")
    mark, gone_id, gone_mark = fresh(docs.columns, "mark", "gone_id", "gone_mark")
    named = lambda df: df.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    same = lambda df: (df[id_col].cast("long") == F.col(gone_id)) & (df[mark] == F.col(gone_mark))
    marked = docs.withColumn(mark, _mark(text_col))
    left = marked.join(gated(checkpointed(named(gone.union(more)))), same(marked), "left_anti")
    alike = checkpointed(named(among.where("mark = first").groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).where("rows > 1")))
    if alike.head(1):  # rows that repeat both identifier and text
        alike = gated(alike)
        left = left.join(alike, same(left), "left_anti").union(left.join(alike, same(left), "left_semi").dropDuplicates([id_col, mark]))
    return left.drop(mark)

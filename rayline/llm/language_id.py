"""Language identification by word-first backoff.

A word the model knows scores its log frequency in each language.  An unseen word falls back to its character
n-grams: at each place the longest known one, from four characters down to one, and the word scores their mean.
The model knows every label; it is fitted on a bounded sample of the documents of each and has a bounded number of
words and n-grams of each.  Distinct words are numbered and scored once, all new ones of a batch together; a text's
score is the sum over its words' rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Batches, checkpointed, gated, tidy

UNKNOWN = "und"
LONGEST = 4
#: Bounds of the model: labelled documents of each language (those of the lowest hashes), and known words and n-grams
#: of each length of a language, and of all languages together while these are at most FIT_LANGUAGES.  With more
#: languages each has as many as one of FIT_LANGUAGES would have, and scores are kept sparse.
FIT_DOCUMENTS, FIT_LANGUAGES, FIT_WORDS, FIT_GRAMS, FIT_ALL = 1500, 256, 20_000, 8_000, 400_000
#: Words a worker remembers, and scores of these words in all languages.
WORDS_KEPT, SCORES_KEPT = 300_000, 300_000 * 64
#: Texts judged together, and entries of the arrays that hold their words' scores at a time.
BATCH_ROWS, AT_ONCE = 500, 1 << 22
TOKEN = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return TOKEN.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams_at(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Batches) -> Batches:
    """(lang, length, gram, count) of one partition: length 0 for words."""
    words: dict[str, Counter] = defaultdict(Counter)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words[lang].update(letters(text or ""))
    for lang, found in words.items():
        tables = [found, *(Counter() for _ in range(LONGEST))]
        for word, count in found.items():
            for n in range(1, LONGEST + 1):
                for gram in grams_at(word, n):
                    tables[n][gram] += count
        for n, table in enumerate(tables):
            if table:
                size = len(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([n] * size, pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())],
                    ["lang", "length", "gram", "count"],
                )


class _Sparse:
    """Log frequencies of entries by language, of which most are those of an entry the language does not have."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, height: int, width: int) -> None:
        totals = np.maximum(0.5 * height + np.bincount(columns, counts, width), 1)
        order = np.argsort(rows, kind="stable")
        self.columns, self.starts = columns[order].astype(np.int32), np.searchsorted(rows[order], np.arange(height + 1))
        self.values = np.log((0.5 + counts[order]) / totals[self.columns])
        self.floor = np.log(0.5 / totals)

    def __getitem__(self, rows: int | list[int]) -> np.ndarray:
        out = np.tile(self.floor, (np.size(rows), 1))
        for line, row in zip(out, np.atleast_1d(rows), strict=True):
            some = slice(self.starts[row], self.starts[row + 1])
            line[self.columns[some]] = self.values[some]
        return out if isinstance(rows, list) else out[0]


class _Trie:
    """Known n-grams by their characters: edges (node, character) in order, and the row of each node that is an n-gram."""

    def __init__(self, grams: dict[str, int]) -> None:
        number: dict[str, int] = {"": 0}
        for gram in grams:
            for n in range(1, len(gram) + 1):
                number.setdefault(gram[:n], len(number))
        self.rows = np.full(len(number), -1, np.int64)
        self.rows[[number[g] for g in grams]] = list(grams.values())
        edges = sorted((number[g[:-1]] << 21 | ord(g[-1]), node) for g, node in number.items() if g)
        self.edges, self.nodes = np.array(edges, np.int64).reshape(-1, 2).T

    def longest(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of the longest n-gram that begins at each start and reaches no further than its end; -1 if none."""
        best = np.full(len(starts), -1, np.int64)
        at, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for n in range(LONGEST):
            at, node = at[starts[at] + n < ends[at]], node[starts[at] + n < ends[at]]
            if not len(at) or not len(self.edges):
                break
            keys = node << 21 | text[starts[at] + n]
            place = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            there = self.edges[place] == keys
            at, node = at[there], self.nodes[place[there]]
            rows = self.rows[node]
            best[at[rows >= 0]] = rows[rows >= 0]
        return best


@dataclass
class Model:
    """Languages, and per n-gram length (0: words) the rows of known entries and their log frequencies."""

    languages: list[str]
    rows: list[dict[str, int]]
    scores: list[np.ndarray | _Sparse]
    trie: _Trie = field(init=False)

    def __post_init__(self) -> None:
        """Rows of the trie count on from length to length; rows of a length begin at its base."""
        self.bases = np.cumsum([0, *(len(self.rows[n]) for n in range(1, LONGEST + 1))])
        self.trie = _Trie({g: int(self.bases[n - 1]) + row for n in range(1, LONGEST + 1) for g, row in self.rows[n].items()})

    @classmethod
    def of(cls, languages: list[str], entries: list[tuple[str, int, str, int]]) -> Model:
        column = {lang: i for i, lang in enumerate(languages)}
        rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, n, gram, _ in entries:
            rows[n].setdefault(gram, len(rows[n]))
        scores = []
        for n in range(LONGEST + 1):
            if len(languages) > FIT_LANGUAGES:
                own = [(rows[n][gram], column[lang], count) for lang, m, gram, count in entries if m == n]
                scores.append(_Sparse(*np.array(own, np.int64).reshape(-1, 3).T, len(rows[n]), len(languages)))
                continue
            table = np.full((len(rows[n]), len(languages)), 0.5)
            for lang, m, gram, count in entries:
                if m == n:
                    table[rows[n][gram], column[lang]] += count
            scores.append(np.log(table / np.maximum(table.sum(axis=0), 1)) if len(table) else table)
        return cls(languages, rows, scores)

    def gram_scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of rows of the trie."""
        out = np.empty((len(rows), len(self.languages)))
        length = np.searchsorted(self.bases, rows, side="right")
        for n in np.unique(length):
            mine = length == n
            out[mine] = self.scores[n][(rows[mine] - self.bases[n - 1]).tolist()]
        return out

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not known: the mean over the longest known n-gram at each place; 0 without any."""
        out = np.zeros((len(words), len(self.languages)))
        text = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        starts = np.delete(np.arange(len(text)), ends - 1)  # no n-gram begins at the space after a word
        word = np.repeat(np.arange(len(words)), sizes - 1)
        rows = self.trie.longest(text, starts, ends[word])
        word, rows = word[rows >= 0], rows[rows >= 0]
        step = max(1, AT_ONCE // max(1, len(self.languages)))
        for at in range(0, len(rows), step):
            mine = word[at : at + step]
            heads = np.flatnonzero(np.diff(mine, prepend=-1))
            out[mine[heads]] += np.add.reduceat(self.gram_scores(rows[at : at + step]), heads)
        return out / np.maximum(np.bincount(word, minlength=len(words)), 1)[:, None]

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words in all languages."""
        out = np.empty((len(words), len(self.languages)))
        rows = [self.rows[0].get(w, -1) for w in words]
        seen = np.array(rows, np.int64) >= 0
        if seen.any():
            out[seen] = self.scores[0][[r for r in rows if r >= 0]]
        if not seen.all():
            out[~seen] = self.unseen([w for w, r in zip(words, rows, strict=True) if r < 0])
        return out


def sample(rows: DataFrame) -> DataFrame:
    """(lang, text): of each language's rows (doc_id, lang, text) the FIT_DOCUMENTS with the lowest hashes.

    The hash is of identifier and text, so rows without an identifier are told apart by their texts, and rows that
    repeat both count once.  A share that is likely to hold enough is taken first, by a count of distinct hashes.
    """
    keyed = rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11))
    sizes = checkpointed(keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("rows")))
    below = gated(sizes.select(F.col("lang").alias("of"), F.least(F.lit(1.0), 1.5 * FIT_DOCUMENTS / F.col("rows")).alias("share")))
    some = keyed.join(below, F.col("lang") == F.col("of")).where(F.col("key") < F.col("share") * float(1 << 53))
    once = some.groupBy("lang", "key").agg(F.first("text").alias("text"))
    lowest = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return once.withColumn("place", lowest).where(F.col("place") <= FIT_DOCUMENTS).select("lang", "text")


def fit(df: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with a label, of those `usable` marks: at most FIT_DOCUMENTS whole texts a language, chosen by hash.

    Every label is learned, so the model and the driver's share of the work grow with the number of labels.  Null and
    empty texts teach nothing; a table without labels gives a model without languages.
    """
    labelled = df.where(F.col(lang_col).isNotNull() & (F.lit(True) if usable is None else usable))
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen = checkpointed(sample(rows))
    languages = [r["lang"] for r in chosen.select("lang").distinct().collect()]
    if not languages:
        return Model.of([], [])
    counted = chosen.mapInArrow(tidy(_counts), "lang string, length int, gram string, count long").groupBy("lang", "length", "gram").agg(F.sum("count").alias("count"))
    most = FIT_ALL // min(len(languages), FIT_LANGUAGES) // (LONGEST + 1)
    rank = F.row_number().over(Window.partitionBy("lang", "length").orderBy(F.desc("count"), "gram"))
    known = counted.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("length") == 0, min(FIT_WORDS, most)).otherwise(min(FIT_GRAMS, most)))
    entries = [tuple(r) for r in known.select("lang", "length", "gram", "count").collect()]
    return Model.of(sorted(languages), sorted(entries))


class _Known:
    """Words met by a worker, as rows of one growing table of scores; judges texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.row = model, {}
        self.table = np.empty((1 << 12, len(model.languages)), np.float32)
        self.kept = min(WORDS_KEPT, max(1 << 12, SCORES_KEPT // max(1, len(model.languages))))

    def learn(self, words: set[str]) -> None:
        """Number new words and score them, all together."""
        if len(self.row) + len(words) > self.kept:
            self.row.clear()
        new = sorted(words.difference(self.row))
        first = len(self.row)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        if new:
            self.table[first : first + len(new)] = self.model.score(new)
            self.row.update(zip(new, range(first, first + len(new)), strict=True))

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        split = [letters(x) if x else [] for x in texts]
        split = [x if self.model.languages and has_letter(x) else [] for x in split]
        out, best = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        told = np.array([bool(x) for x in split], bool)
        if told.any():
            self.learn(set().union(*split))
            sizes = np.array([len(x) for x in split if x])
            rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            of = np.repeat(np.arange(len(sizes)), sizes)
            total = np.zeros((len(sizes), len(self.model.languages)))
            step = max(1, AT_ONCE // len(self.model.languages))
            for at in range(0, len(rows), step):
                mine = of[at : at + step]
                heads = np.flatnonzero(np.diff(mine, prepend=-1))
                total[mine[heads]] += np.add.reduceat(self.table[rows[at : at + step]], heads, dtype=np.float64)
            best[told] = total.argmax(axis=1)
            out[told] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.languages[i] if t else UNKNOWN for i, t in zip(best.tolist(), told.tolist(), strict=True)], out


def _predict(shared):
    def run(batches: Batches) -> Batches:
        known = _Known(shared.value)
        for b in batches:
            languages, scores = known.judge(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; the score is the language's posterior under equal priors.

    A null text, one without a letter, and every text under a model without languages is `und` with score 0.  Rows
    are judged one by one: null or repeated identifiers and other columns do not matter, and an empty table gives no
    rows.  Equal scores go to the label that sorts first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_predict(shared), BATCH_ROWS), "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A third of identifiers, by checksum, that no model learns from; rows without an identifier are none of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def held_out_predictions(df: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the labelled rows that are not held out, applied to all."""
    model = fit(df, ~held_out())
    return identify(df, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """`docs` without those rejected: `und`, or a score below `least`.  All columns stay; text travels once.

    With `lang_col` that column of `docs` becomes the identified language.  A model without languages (no row has a
    label) can tell none apart: then only texts without a letter are rejected, and labels stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Batches) -> Batches:
        known = _Known(shared.value)
        for b in batches:
            texts = b.column(columns.index(text_col)).to_pylist()
            if known.model.languages:
                languages, scores = known.judge(texts)
                kept = pa.array([x != UNKNOWN for x in languages]), pa.array(scores >= least)
                if lang_col is not None:
                    b = b.set_column(columns.index(lang_col), b.schema.field(columns.index(lang_col)), pa.array(languages, pa.string()))
                yield b.filter(pc.and_(*kept))
            else:
                yield b.filter(pa.array([has_letter(letters(x or "")) for x in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run, BATCH_ROWS), docs.schema)

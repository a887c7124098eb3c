"""Byte-pair encoding and decoding by a segment tree over adjacent pair ranks.

A word's symbols are the leaves' positions; leaf i holds (rank of the pair at i, i), or nothing where no merge is
known, and every inner node the smaller of its children.  The root is therefore the leftmost pair of lowest rank.  A
merge rewrites three leaves and their ancestors, so a word of n symbols takes O(n log n) however it merges.  Short
words are merged many at a time, one tree per column of an array; a long one has a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import Batches, tidy

WORDS_KEPT = 300_000
#: Rows whose texts are encoded together.
BATCH_ROWS = 500
#: Words up to this many symbols are merged together in arrays.
WIDE = 64
NO_RANK = np.int64(2**62)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a tokenizer file, in a form that is cheap to send to executors."""

    tokens: list[bytes]
    first: np.ndarray  # id of a byte inside a word
    last: np.ndarray  # id of a byte that ends a word
    pairs: np.ndarray  # sorted left * len(tokens) + right
    ranks: np.ndarray  # by pair
    merged: np.ndarray  # by rank
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ids = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *special.values()])
        tokens = [b""] * size
        for token, i in (ids | special).items():
            tokens[i] = token.encode()
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        letters = byte_letters()
        return cls(
            tokens, np.array([ids[x] for x in letters], np.int64), np.array([ids[x + suffix] for x in letters], np.int64),
            keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int64), special,
        )

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where none is known or an end is missing (-1)."""
        keys = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        ids = self.first[raw]
        ids[-1] = self.last[raw[-1]]
        return ids


def merge_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """Merge one word with a segment tree of its own."""
    tok = v.symbols(word).tolist()
    n = len(tok)
    size = 1 << max(1, (n - 1).bit_length())
    known, width = getattr(v, "_known", None), len(v.tokens)
    if known is None:
        known = v._known = dict(zip(v.pairs.tolist(), v.ranks.tolist(), strict=True))
    none = 1 << 62
    start = np.array(tok, np.int64)
    leaves = np.full(size, none, np.int64)
    ranks = v.rank(start[:-1], start[1:])
    leaves[: n - 1] = np.where(ranks == NO_RANK, none, ranks * size + np.arange(n - 1))
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    tree = [none, *(x for level in reversed(levels) for x in level.tolist())]
    nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
    alive = bytearray(b"\x01") * n
    while (root := tree[1]) < none:
        i, rank = root % size, root // size
        j = nxt[i]
        tok[i], alive[j] = int(v.merged[rank]), 0
        k = nxt[i] = nxt[j]
        leaf = {j: none, i: none}
        if k < n:
            prv[k] = i
            if (r := known.get(tok[i] * width + tok[k])) is not None:
                leaf[i] = r * size + i
        if (p := prv[i]) >= 0:
            r = known.get(tok[p] * width + tok[i])
            leaf[p] = none if r is None else r * size + p
        for at, value in leaf.items():
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
    return np.array([t for t, live in zip(tok, alive, strict=True) if live], np.uint32)


def merge_many(words: list[bytes], v: Vocabulary, width: int) -> list[bytes]:
    """Merge words of at most `width` (a power of two) symbols, one tree per column; ids as little-endian 32-bit bytes."""
    count = len(words)
    sizes = np.array([len(w) for w in words])
    tok = np.full((width + 1, count), -1, np.int64)  # the last row stands for the missing neighbour
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width).T
    inside = np.arange(width)[:, None] < sizes
    tok[:width][inside] = v.first[raw][inside]
    columns = np.arange(count)
    tok[sizes - 1, columns] = v.last[raw[sizes - 1, columns]]
    nxt = np.repeat(np.arange(1, width + 2)[:, None], count, axis=1)
    nxt[sizes - 1, columns] = width
    prv = np.repeat(np.arange(-1, width)[:, None], count, axis=1)
    prv[0] = width
    alive = np.zeros((width + 1, count), bool)
    alive[:width] = inside
    tree = np.full((2 * width, count), NO_RANK)
    ranks = v.rank(tok[: width - 1], tok[1:width])
    tree[width : 2 * width - 1] = np.where(ranks == NO_RANK, NO_RANK, ranks * width + np.arange(width - 1)[:, None])
    for node in range(width - 1, 0, -1):
        tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
    c = np.flatnonzero(tree[1] < NO_RANK)
    while len(c):
        root = tree[1, c]
        i, rank = root % width, root // width
        j = nxt[i, c]
        k, p = nxt[j, c], prv[i, c]
        tok[i, c], alive[j, c], nxt[i, c], prv[k, c] = v.merged[rank], False, k, i
        here = tok[i, c]
        after, before = v.rank(here, tok[k, c]), v.rank(tok[p, c], here)
        tree[width + j, c] = NO_RANK
        tree[width + i, c] = np.where(after == NO_RANK, NO_RANK, after * width + i)
        q = np.where(p == width, i, p)  # no left neighbour: nothing more to write
        tree[width + q, c] = np.where(p == width, tree[width + i, c], np.where(before == NO_RANK, NO_RANK, before * width + p))
        for node in (width + j, width + i, width + q):
            while node[0] > 1:
                node = node >> 1
                tree[node, c] = np.minimum(tree[2 * node, c], tree[2 * node + 1, c])
        c = c[tree[1, c] < NO_RANK]
    kept = alive[:width].T
    flat = tok[:width].T[kept].astype("<u4").tobytes()
    ends = 4 * np.cumsum(kept.sum(axis=1))
    return [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_words(words: list[bytes], v: Vocabulary) -> dict[bytes, bytes]:
    """The ids of each word, as little-endian 32-bit bytes."""
    by_width: dict[int, list[bytes]] = {}
    out = {}
    for w in words:
        if len(w) == 1:
            out[w] = v.symbols(w).astype("<u4").tobytes()
        elif len(w) > WIDE:
            out[w] = merge_long(w, v).astype("<u4").tobytes()
        else:
            by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(w)
    for width, some in by_width.items():
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            out.update(zip(part, merge_many(part, v, width), strict=True))
    return out


#: How the word tokenizer's file splits lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts in which ODD finds nothing, on which the two engines' classes agree; faster.
PLAIN_PATTERN = r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+"
ODD = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


class WordEncoder:
    """Splits, normalises and encodes whole texts, remembering words."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known = v, {}
        self.plain, self.full = re.compile(PLAIN_PATTERN), regex.compile(WORD_PATTERN)
        marks = "|".join(re.escape(x) for x in sorted(v.special, key=len, reverse=True))
        self.special = re.compile(f"({marks})") if marks else None

    def split(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens, whose strings are looked for in the text as it stands."""
        out: list[str | int] = []
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            if part in self.v.special:
                out.append(self.v.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each capital alone, whatever follows it
            part = part.lower()
            out += (self.full if ODD.search(part) else self.plain).findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        split = [self.split(x) for x in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = list(set().union(*split).difference(self.known)) if split else []
        self.known.update((i, int(i).to_bytes(4, "little")) for i in new if isinstance(i, int))
        raw = {w: w.encode("utf-8", "surrogatepass") for w in new if not isinstance(w, int)}
        ids = merge_words(list(set(raw.values())), self.v)
        self.known.update((w, ids[b]) for w, b in raw.items())
        return [b"".join(map(self.known.__getitem__, x)) for x in split]


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The tokens' strings joined by spaces, as a tokenizer file without a decoder defines it; UTF-8."""
    return b" ".join(map(v.tokens.__getitem__, ids.tolist()))


CODED = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _code(shared, digests: bool):
    def run(batches: Batches) -> Batches:
        v = shared.value
        encoder = WordEncoder(v)
        for b in batches:
            ids = encoder.encode([x or "" for x in b.column("text").to_pylist()])
            decoded = (decode(np.frombuffer(x, "<u4"), v) for x in ids)
            lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
                columns, names = [sha(ids), sha(decoded)], ["ids_sha256", "decoded_sha256"]
            else:
                columns, names = [pa.array(ids, pa.binary()), pa.array(list(decoded), pa.binary())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lengths, *columns], ["doc_id", "n_tokens", *names])

    return run


def bpe_encode(df: DataFrame, vocabulary: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: (doc_id, n_tokens, ids, decoded), or digests of the two.

    `vocabulary` is the path of a byte-level BPE file with word ends, read once on the driver and sent to executors
    (a few MB).  A null text is the empty text: no ids, and an empty decoded text.  Null identifiers, repeated rows
    and other columns do not matter, as each row is coded by itself; an empty table gives no rows.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(vocabulary))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_code(shared, digests), BATCH_ROWS), DIGESTS if digests else CODED)

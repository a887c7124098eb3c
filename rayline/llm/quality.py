"""Quality rules as a bitmask ledger.

Every rule is evaluated once: the ledger keeps a document's measurements and one bit per failed rule.  A policy is a
versioned mask over these bits, so applying one, or changing it, reads the ledger and no text.  Ablations are
aggregates by distinct bit pattern, of which there are at most two to the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Batches, as_bytes, tidy

#: Characters that count as symbols, and white space, as bytes to delete.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds; conditions are whole-number arithmetic."""

    name: str
    fails: str


#: The bit of a rule is its place here; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("longest_word", "longest_word > 1000"),
)


def mask(*names: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in names)


BASE = mask("few_words", "repeated_words")

#: Policies by version: a document is kept if none of the policy's rules failed.
POLICIES = {
    1: BASE,
    2: BASE | mask("symbols", "repeated_lines", "short_words", "long_words", "longest_word"),
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    size = len(ids)
    pair = a[:-1] * size + a[1:]
    if size > 2_000_000:  # three ids no longer fit one number: name the pairs first
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * size + a[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[j : n - 2 + j] |= twice
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, longest_word (bytes)."""
    words = text.split()
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    blanks = len(text) - len(text.translate(None, BLANKS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return (
        len(words), chars - blanks, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(max(words, key=len, default=b"")),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word")


def _measure(batches: Batches) -> Batches:
    for b in batches:
        rows = [measure(x) for x in as_bytes(b.column("text"))]
        columns = zip(*rows, strict=True) if rows else ([] for _ in MEASURES)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, rule_bits), one row per row of `df`.

    A null or empty text has no words, and fails the rule of few words only.  Rows are measured one by one: null or
    repeated identifiers and other columns do not matter, and an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = rows.mapInArrow(tidy(_measure), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("rule_bits", total)


def failed(version: int | Column) -> Column:
    """Whether a ledger row fails a policy, or the policy its row names; null where it names none."""
    if isinstance(version, Column):
        rules = F.coalesce(*[F.when(version == v, F.lit(m).cast("long")) for v, m in POLICIES.items()])
    else:
        rules = F.lit(POLICIES[version]).cast("long")
    return F.col("rule_bits").bitwiseAND(rules) != 0


def judged(df: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    base = F.col("rule_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return ledger(df).withColumn("base_failed", base).withColumn("kept", ~base & ~failed(version)).withColumn("policy", F.lit(version))


def ablations(book: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    Patterns of bits are counted first, so the work after one pass over the ledger does not grow with it.
    """
    patterns = book.groupBy(F.col("rule_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")).alias("bits")).agg(F.count("*").alias("rows"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if POLICIES[version] >> i & 1])
    rows = lambda on: F.coalesce(F.sum(F.when(on, F.col("rows"))), F.lit(0)).alias
    each = patterns.withColumn("r", F.explode(rules))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        rows(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)("failed"),
        rows(F.col("bits") == F.col("r.bit"))("failed_alone"),
        rows(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0)("kept_without"),
    )

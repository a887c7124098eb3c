"""Street names: a transliteration-tolerant normal form and a four-rule match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import let, trimmed

#: Spellings of Greek names, replaced one after the other in this order.
SPELLINGS = (("ou", "u"), ("ch", "k"), ("th", "t"), ("ph", "f"), ("ai", "e"), ("ei", "i"), ("oi", "i"), ("x", "k"), ("w", "o"))
NO_NAME = "UNKNOWN"


def normalize_name(c: Column) -> Column:
    """Trimmed, lower-cased, white space runs as one space, spellings replaced.  Apply once: a second pass may differ."""
    base = F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, base)


def last_token(c: Column) -> Column:
    return F.substring_index(c, " ", -1)


def contains_either(a: Column, b: Column) -> Column:
    """One contains the other; the empty text is in every text."""
    return F.contains(a, b) | F.contains(b, a)


def length_limit(a: Column, b: Column) -> Column:
    """Edits allowed between whole names: 0.3 of the shorter one, 2 at least."""
    return F.greatest(F.lit(2), (F.least(F.length(a), F.length(b)) * F.lit(0.3)).cast("int"))


def match_rule(a: Column, b: Column) -> Column:
    """The first rule by which two names match, or 0: 1 equal, 2 contained, 3 last words, 4 whole names.

    A null or `UNKNOWN` on either side matches nothing.  Rules run from cheap to dear and stop at the first.
    """
    known = a.isNotNull() & b.isNotNull() & (a != NO_NAME) & (b != NO_NAME)

    def by_rules(n: Column) -> Column:
        x, y = n["x"], n["y"]
        return (
            F.when(x == y, 1)
            .when(contains_either(x, y), 2)
            .when(F.levenshtein(last_token(x), last_token(y)) <= 2, 3)
            .when(F.levenshtein(x, y) <= length_limit(x, y), 4)
            .otherwise(0)
        )

    normal = F.struct(normalize_name(a).alias("x"), normalize_name(b).alias("y"))
    return F.when(~F.coalesce(known, F.lit(False)), 0).otherwise(let(normal, by_rules))


def fuzzy_match(a: Column, b: Column) -> Column:
    return match_rule(a, b) > 0


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)

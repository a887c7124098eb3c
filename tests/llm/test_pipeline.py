"""The pipeline's stages against brute-force versions of each."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark, tmp_path):
    random.seed(11)
    stock = [f"{a}{b}" for a in ("ka", "lo", "mi", "re") for b in ("n", "st", "ra", "pel", "do")]
    rows = [(i, " ".join(random.choice(stock) for _ in range(60)), "aa", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", 1), "aa", "s0", 1) for i in range(10)]  # exact copies
    rows += [(200 + i, rows[i][1] + " extra", "aa", "s1", 1) for i in range(10, 20)]  # near copies
    rows += [(300, "1234 !", "aa", "s2", 1), (301, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "mixture", "token_ids"]

    def through(name, df):
        stages[name](spark, df, "").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "token_ids":
            assert out.columns == docs.columns
        return out

    known = through("language", docs)
    assert {r["doc_id"] for r in known.collect()} == {r[0] for r in rows} - {300, 301}
    exact = through("exact_copies", known)
    assert {r["doc_id"] for r in exact.collect()} == {r[0] for r in rows} - {300, 301} - set(range(100, 110))
    near = through("near_copies", exact)
    kept = near.collect()
    assert {r["doc_id"] for r in kept} == set(range(60))
    sets = [shingles(r["text"]) for r in kept]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    mixed = through("mixture", near)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= set(range(60)) and max(copies.values()) <= 3
    words = {r["doc_id"]: len(r["text"].split()) for r in kept}
    assert abs(sum(words[i] * n for i, n in copies.items()) - sum(words.values())) <= 0.1 * sum(words.values())
    coded = through("token_ids", mixed)
    assert Counter(r["doc_id"] for r in coded.collect()) == copies


ODD = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _mark string, _order string, shard string, label string"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and identifiers."""
    more = ("g", "m", "o", "s", "l")
    stock = " ".join(f"kala{c}" for c in "abcdefghijklmnop")
    return [
        (1, stock, "aa", "s0", 1, *more), (1, stock, "aa", "s0", 1, *more), (1, stock + " lone", None, "s0", 1, *more), (2, stock + " kalax", "aa", None, 1, *more),
        (3, None, None, None, None, *[None] * 5), (4, "", "aa", "s1", 0, *more), (None, stock, "aa", "s1", 1, *more), (None, None, None, None, None, *[None] * 5),
        (5, "strom kopf zwei " * 20_000, "bb", "s1", 9, *more), (6, "strom kopf", "bb", "s2", 2, *more), (7, "kopf strom", "bb", "s2", 2, *more), (8, " \n\t", "bb", "s2", 3, *more),
    ]


@pytest.mark.parametrize("name", ["language", "exact_copies", "near_copies", "mixture", "token_ids"])
def test_stage_takes_odd_rows(spark, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    out = stage(spark, docs, "")
    got = Counter(map(tuple, out.collect()))
    if name == "language":  # no null, empty or blank text; `lang` is what was identified
        kept = [r for r in rows if r[1] and r[1].strip()]
        assert Counter(r[:2] + r[3:] for r in got.elements()) == Counter(r[:2] + r[3:] for r in kept)
        assert {r[2] for r in got} == {"aa", "bb"} and all((r[2] == "aa") == r[1].startswith("kala") for r in got)
    if name == "exact_copies":  # the repeated row, the copy without identifier, one of the empty texts
        assert Counter((r[0], (r[1] or "")[:20]) for r in got.elements()) == Counter([(1, rows[0][1][:20])] * 2 + [(2, rows[3][1][:20]), (3, ""), (5, rows[8][1][:20]), (6, "strom kopf"), (7, "kopf strom"), (8, " \n\t")])
    if name == "near_copies":  # of the component's rows under identifier 1 one stays; rows without identifier stay
        left = Counter(r[0] for r in got.elements())
        assert left == Counter({1: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1, 8: 1})
    if name == "mixture":
        assert set(got) <= set(rows) and got[rows[0]] % 2 == 0
    if name == "token_ids":
        assert sum(got.values()) == len(rows) and set(out.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}
    else:
        assert out.schema.names == docs.schema.names
    assert stage(spark, docs.where("false"), "").count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "kala", None, "s", 1), (2, "12", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect()] == [(1, "kala", None, "s", 1)]


def test_run_on_small_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}

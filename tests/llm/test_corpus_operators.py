"""Sharding, WARC, mixing, joins and deduplication against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rayline.llm import components as component_module, exact_dedup, mixing, ngram_join, sharding, warc
from rayline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, source string, keep_id string, component_id string, cols string, digest string, node string, size string, target string, block string"


def table(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], CLASHING)


def documents(seed=4, n=160):
    random.seed(seed)
    stock = [f"w{i}" for i in range(400)]
    passage = " ".join(random.choice(stock) for _ in range(60))
    rows = []
    for i in range(n):
        words = [random.choice(stock) for _ in range(random.choice([1, 3, 10, 60, 200]))]
        rows.append((i, " ".join(words) + (" " + passage if i % 5 == 0 else ""), f"s{i % 4}" if i % 11 else None))
    for i in range(n, 2 * n):
        words = (rows[i % 40][1] or "").split(" ")
        for _ in range(random.choice([0, 1, 2, 6])):
            words[random.randrange(len(words))] = "new" + str(random.randrange(50))
        rows.append((i, random.choice([" ", "  ", "\n"]).join(words).upper() if i % 3 == 0 else " ".join(words), "s0"))
    return [*rows, (5000, None, "s1"), (5001, "", None), (5002, " \t\n", "s1"), (None, rows[1][1], "s1"), (7, rows[7][1], "s3")]


def brute_components(rows, words, num, den):
    sets = []
    for _, text, _ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    low = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return Counter((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("law", [ngram_join.Law(4, 85, 100), ngram_join.Law()])
def test_jaccard_components(spark, law, monkeypatch):
    rows = documents()
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(table(spark, rows), law).collect())
    assert got == brute_components(rows, law.words, law.num, law.den)
    assert any(i != c for i, _, c in got if i is not None)


def test_jaccard_components_in_many_blocks(spark, monkeypatch):
    """Small blocks: a family is cut by size class and hash."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "DENSE_FROM", 2)
    rows = documents(9)
    law = ngram_join.Law(4, 85, 100)
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(table(spark, rows), law).collect())
    assert got == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("many", [1, 1000])
def test_jaccard_of_a_long_chain_and_a_large_group(spark, monkeypatch, many):
    """Families of many parts: texts that overlap their neighbours too little to link, and a group of alike texts."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngram_join, "MANY_PARTS", many)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 3)
    random.seed(12)
    stream = [f"s{random.randrange(10**6)}" for _ in range(1200)]
    rows = [(i, " ".join(stream[i * 9 : i * 9 + random.choice([40, 44, 60])]), "a") for i in range(110)]
    rows += [(200 + i, " ".join(stream[i * 30 + 1 : i * 30 + 41]), "a") for i in range(30)]
    base = [f"g{i}" for i in range(90)]
    for i in range(60):
        words = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 9])):
            words[random.randrange(90)] = f"o{random.randrange(10**6)}"
        rows.append((300 + i, " ".join(words + stream[:3]), "a"))
    rows += [(400 + i, rows[-1][1], "a") for i in range(8)] + [(500, None, "a"), (501, "", "a"), (None, rows[0][1], "a")]
    for law in (ngram_join.Law(4, 85, 100), ngram_join.Law()):
        got = Counter(tuple(r) for r in ngram_join.jaccard_components(table(spark, rows), law).collect())
        assert got == brute_components(rows, law.words, law.num, law.den)


def test_leading_columns_travel_once(spark, monkeypatch):
    """Columns are counted where they meet: heads come from one list of them, not from a list and a table of counts."""
    plans, real = [], ngram_join.checkpointed
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or real(df))
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " x"), (3, "some other words of a text"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    (plan,) = [p for columns, p in plans if "rare" in columns]
    assert plan.count("Generate explode(cols") == 1


def test_products_of_two_sides():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) if (i < 15) != (j < 15) else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert ngram_join.overlaps(sets, 15).tolist() == want


def test_near_copies_keep_clashing_columns(spark):
    schema = "doc_id long, text string, _mark string, mark string, MARK_ string, gone_id string, _gone string, first string, rows string, label string"
    rows = [(i, "one two three four five six" if i < 3 else f"text {i}", *"abcdefgh") for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], *rows[3:]]
    assert ngram_join.drop_near_copies(df.where("false")).count() == 0


def test_jaccard_of_nothing_and_of_one_hot_group(spark):
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0
    same = [(i, "one two three four five six seven", "s") for i in range(50, 0, -1)]
    assert {tuple(r) for r in ngram_join.jaccard_components(table(spark, same)).collect()} == {(i, 3, 1) for i in range(1, 51)}
    kept = ngram_join.drop_near_copies(table(spark, same))
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == table(spark, same).columns


def test_near_copies_with_repeated_identifiers(spark):
    """A clean text stays though its identifier also names a near copy; of copies under one identifier one row stays."""
    words = [f"w{i}" for i in range(100)]
    near, clean, other, odd = " ".join(words), " ".join(reversed(words)), " ".join(w + "x" for w in words), " ".join(w + "y" for w in words)
    rows = [(1, near, "s"), (2, near + " more", "s"), (2, clean, "s"), (3, other, "s"), (3, other + " more", "s"), (3, odd, "s")]
    rows += [(4, "one", "s"), (4, "one", "s"), (5, "", "s"), (5, "", "s"), (6, "", "s"), (None, near, "s"), (None, near, "s")]
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(table(spark, rows)).collect())
    assert sum(n for (i, t), n in kept.items() if i == 3 and t != odd) == 1
    kept = Counter({k: n for k, n in kept.items() if k[0] != 3 or k[1] == odd})
    assert kept == Counter({(1, near): 1, (2, clean): 1, (3, odd): 1, (4, "one"): 1, (5, ""): 2, (6, ""): 1, (None, near): 2})


def test_overlap_product():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert ngram_join.overlaps(sets).tolist() == want


def test_connected_components(spark, monkeypatch):
    random.seed(6)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (1, 2), (2, 1)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}
    monkeypatch.setattr(component_module, "BROADCAST_ROWS", 0)  # as with many edges and hubs
    monkeypatch.setattr(component_module, "HUB_EDGES", 3)
    assert got == {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    rows = documents() * 2
    random.shuffle(rows)
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    want = Counter()
    for norm, ids in groups.items():
        keep = min((x for x in ids if x is not None), default=None)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want += Counter((i, keep, len(ids), False, digest) for i in ids)
        want -= Counter({(keep, keep, len(ids), False, digest): 1})
        want += Counter({(keep, keep, len(ids), True, digest): 1})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs over many partition edges
    try:
        for parts in ("4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = Counter(tuple(r) for r in exact_dedup.exact_dedup(table(spark, rows)).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    kept = exact_dedup.drop_exact_copies(table(spark, rows)).collect()
    assert len(kept) == len(groups) and len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept}) == len(groups)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_sharding(spark):
    rows = documents()
    got = sharding.rendezvous_shards(table(spark, rows), 24).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    more = {r["doc_id"]: r["shard"] for r in sharding.rendezvous_shards(table(spark, rows), 25).collect()}
    assert all(more[r["doc_id"]] == r["grown_shard"] for r in got)
    assert sharding.rendezvous_shards(table(spark, []), 24).count() == 0


def plain_winner(key, weights):
    """The shard with the least bid, from the hash's own library."""
    best = None
    for shard, weight in enumerate(weights):
        seed = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), 42)
        value = xxhash.xxh64_intdigest(key.encode(), seed) if key is not None else seed
        bid = -math.log(((value >> 11) + 0.5) / 2**53) / weight if weight > 0 else math.inf
        best = min(best or (bid, shard), (bid, shard))
    return best[1]


def test_sharding_equals_plain_bids(spark):
    rows = documents()
    for weights in ([1.0] * 24, [1.0, 0.5, 4.0]):
        got = {(r["doc_id"], r["shard"], r["grown_shard"]) for r in sharding.rendezvous_shards(table(spark, rows), weights).collect()}
        name = lambda i: None if i is None else str(i)
        assert got == {(i, plain_winner(name(i), weights), plain_winner(name(i), [*weights, 1.0])) for i, _, _ in rows}


def test_splitting_tree_deals_every_copy_once(spark):
    """Quotas add up, shards are equal but for rounding, draws of a source are disjoint, and sources spread by chance."""
    rows = [(f"s{s}", b, 1 + (s + b) % 3) for s in range(5) for b in range(40 * (s + 1))]
    copies = spark.createDataFrame(rows, "source string, block int, copies int")
    counts = {}
    for seed in range(3):
        dealt = mixing._deal(copies, 6, seed).collect()
        assert sorted((r["source"], r["block"], len(r["shards"])) for r in dealt) == sorted(rows)
        total = Counter(x for r in dealt for x in r["shards"])
        assert sum(total.values()) == sum(r[2] for r in rows) and max(total.values()) - min(total.values()) <= 3
        for r in dealt:
            for x in r["shards"]:
                counts[seed, r["source"], x] = counts.get((seed, r["source"], x), 0) + 1
    for s in range(5):
        n = sum(c for name, _, c in rows if name == f"s{s}")
        share = [counts.get((seed, f"s{s}", x), 0) for seed in range(3) for x in range(6)]
        assert all(abs(v - n / 6) < 4.5 * math.sqrt(n * 5 / 36) for v in share) and len(set(share)) > 1


def test_sharding_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    count = {r["shard"]: r["count"] for r in sharding.rendezvous_shards(df, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(count) == {0, 1} and abs(count[1] / count[0] - 3) < 0.2


def water_fill(sizes, weights, cap):
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 7}" if i % 13 else None) for i in range(700)]
    rows += [(i, "tiny source", "z") for i in range(700, 710)] + [(800, None, "s1"), (801, "", "empty")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    count = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sizes = defaultdict(int)
    for i, _, s in rows:
        sizes[s] += count[i]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, 3)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == count[r["doc_id"]] and r["source_size"] == sizes[r["source"] if "source" in r else {i: s for i, _, s in rows}[r["doc_id"]]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        s = {i: s for i, _, s in rows}[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in names)
    shards = Counter(x for r in got for x in r["shards"])
    assert set(shards) == set(range(8)) and max(shards.values()) < 1.5 * min(shards.values())
    again = {r["doc_id"]: (r["taken"], r["shards"]) for r in mixing.mix(table(spark, rows).repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["taken"], r["shards"]) for r in got}
    mixed = Counter(r["doc_id"] for r in mixing.mixed_documents(table(spark, rows)).collect())
    assert mixed == Counter({r["doc_id"]: len(r["shards"]) for r in got if r["shards"]})
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixed_documents(table(spark, [])).count() == 0


def test_mixed_documents_stay_in_their_shards(spark):
    """Each partition of the output is of one shard, in order; clashing names stay as they are."""
    names = ["_s", "_b", "_shards", "_block", "_order", "order", "shard", "path", "dealt", "copy"]
    rows = [(i, "w " * (1 + i % 30), f"s{i % 3}", *names) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(df).collect()
    mixed = mixing.mixed_documents(df, shard_col="dealt_to")
    assert mixed.columns == [*df.columns, "dealt_to"]
    found = mixed.withColumn("part", F.spark_partition_id()).collect()
    assert Counter((r["doc_id"], r["dealt_to"]) for r in found) == Counter((r["doc_id"], x) for r in got for x in r["shards"])
    assert all(tuple(r[n] for n in names) == tuple(names) for r in found)
    shard_of = defaultdict(set)
    for r in found:
        shard_of[r["part"]].add(r["dealt_to"])
    assert all(len(x) == 1 for x in shard_of.values())
    order = [min(shard_of[p]) for p in sorted(shard_of)]
    assert order == sorted(order) and set(order) == set(range(8))
    assert mixing.mixed_documents(df).columns == df.columns


def test_mixing_of_many_sources(spark):
    """More sources than blocks of a round: tables outgrow their usual size, and targets are still met."""
    n = 70_000
    df = spark.range(n + 30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < n, F.concat(F.lit("s"), F.col("id").cast("string"))).otherwise("hot").alias("source"))
    got = mixing.mix(df).groupBy((F.col("doc_id") < n).alias("small")).agg(F.sum("taken").alias("taken"), F.sum("target").alias("target"), F.first("target").alias("each"), F.max(F.abs(F.col("taken") - F.col("target"))).alias("off")).collect()
    by = {r["small"]: r for r in got}
    assert by[True]["off"] <= 3 and abs(by[True]["taken"] - by[True]["target"]) < 0.5 * by[True]["target"]
    assert abs(by[False]["taken"] - by[False]["each"]) <= 3


def test_exact_copies_keep_clashing_columns(spark):
    schema = "doc_id long, text string, _mark string, mark string, gone_id string, _gone string, _sha string, norm string, hash string, head string"
    rows = [(i, "a  b" if i < 3 else f"t{i}", *"abcdefgh") for i in range(6)] + [(7, "t7", *"abcdefgh")] * 2 + [(None, None, *"abcdefgh"), (None, "", *"abcdefgh")]
    df = spark.createDataFrame(rows, schema)
    kept = exact_dedup.drop_exact_copies(df).collect()
    assert exact_dedup.drop_exact_copies(df).columns == df.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or ""), r["_mark"]) for r in kept) == [(0, "", "a"), (0, "a  b", "a"), (3, "t3", "a"), (4, "t4", "a"), (5, "t5", "a"), (7, "t7", "a")]
    assert exact_dedup.drop_exact_copies(df.where("false")).count() == 0


def test_mixing_odd_identifiers(spark):
    """Rows without an identifier share a block; repeated rows are taken alike; texts without words take nothing."""
    rows = [(None, "a b", "s"), (None, "c d e", "s"), (1, "x " * 5000, "t"), (1, "x " * 5000, "t"), (2, None, None), (3, "", None)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and len({tuple(r["shards"]) for r in got if r["doc_id"] is None}) == 1
    assert all(r["taken"] == 0 and r["target"] == 0 for r in got if r["doc_id"] in (2, 3))
    assert len({r["taken"] for r in got if r["doc_id"] == 1}) == 1
    nothing = mixing.mix(table(spark, [(1, None, None), (2, " ", "s")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


def test_mixing_hot_source_among_many(spark):
    """A third of all words in one source of a thousand: its target is a small part of it, but is met."""
    hot = [(i, "w " * (1 + i % 40), "hot") for i in range(20_000)]
    rest = [(100_000 + i, "w " * (1 + i % 40), f"s{i % 999:03}") for i in range(40_000)]
    df = spark.createDataFrame([*hot, *rest], "doc_id long, text string, source string")
    got = mixing.mix(df).withColumn("source", F.when(F.col("doc_id") < 100_000, "hot").otherwise(F.concat(F.lit("s"), F.lpad(((F.col("doc_id") - 100_000) % 999).cast("string"), 3, "0"))))
    by_source = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()}
    assert len(by_source) == 1000
    assert abs(by_source["hot"]["taken"] - by_source["hot"]["target"]) <= 0.005 * by_source["hot"]["target"]
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in by_source.values())
    mixed = mixing.mixed_documents(df)
    assert mixed.where("source = 'hot'").agg(F.sum(mixing.word_count("text"))).first()[0] == by_source["hot"]["taken"]


def pages():
    random.seed(8)
    body = ["<html>" + "x" * random.choice([10, 93, 94, 300]) + str(i) for i in range(12)]
    big = "é" * 150_000
    rows = [(i, f"http://h/{i}", random.choice(body)) for i in range(60, 0, -1)]
    return [*rows, (70, "u", big), (69, "u 2\n", big), (71, None, None), (72, "u", ""), (73, "u", ""), (None, "u", body[2]), (60, "u", body[3] + "z" * 200), (60, "u", body[3] + "z" * 200)]


def test_warc_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, record string")
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = Counter()
    for i, _, html in rows:
        data, low = (html or "").encode(), first.get(html)
        again = low is not None and low != i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", low if again else None] += 1
    assert Counter(tuple(r) for r in warc.archive_round_trip(df).collect()) == want
    warc.write_archive(df, str(tmp_path / "a"))
    assert warc.export_archives(spark, str(tmp_path / "a"), str(tmp_path / "files")) >= 1
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "files").iterdir()))
    records = 0
    while data:  # a plain reader of whole files
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[length : length + 4] == b"\r\n\r\n"
        data, records = rest[length + 4 :], records + 1
    assert records == len(rows)
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_warc_finds_damage():
    reader = warc._Reader()
    digest = hashlib.sha256(b"payload").hexdigest()
    reader.feed(warc.head(1, "u", 7, digest, None) + b"pAyload" + warc.END)
    with pytest.raises(ValueError):
        reader.row()

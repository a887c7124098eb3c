"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_encode
from .exact_dedup import exact_dedup
from .language_id import held_out_predictions
from .mixing import mix
from .ngram_join import Law, jaccard_components
from .pii import personal_data
from .quality import judged
from .sharding import rendezvous_shards
from .token_file import token_round_trip
from .warc import archive_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, read on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return personal_data(_documents(spark, sf_dir))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and the current policy's verdict for every document."""
    return judged(_documents(spark, sf_dir))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by rendezvous hashing, and with one shard more."""
    return rendezvous_shards(_documents(spark, sf_dir), 24)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of two thirds of them."""
    return held_out_predictions(_documents(spark, sf_dir))


def op5_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the word tokenizer and the text decoded from them, as digests."""
    return bpe_encode(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), digests=True)


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, read back from the archives."""
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of as many words as all documents have, sources weighted 1, 2, 3 and taken three times at most."""
    return mix(_documents(spark, sf_dir), weights=(1, 2, 3), cap=3)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 85 % of their distinct 4-word shingles."""
    return jaccard_components(_documents(spark, sf_dir), Law(words=4, num=85, den=100))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' places in token files of the byte tokenizer, read back from the files."""
    return token_round_trip(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end=2)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts after white space is normalised."""
    return exact_dedup(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_anchors": op1_pii_anchors,
        "op2_quality_ledger": op2_quality_ledger,
        "op3_rendezvous_sharding": op3_rendezvous_sharding,
        "op4_language_id": op4_language_id,
        "op5_bpe_encode": op5_bpe_encode,
        "op6_warc_chunks": op6_warc_chunks,
        "op7_source_mixing": op7_source_mixing,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_token_files": op9_token_files,
        "op10_exact_dedup": op10_exact_dedup,
    }


#: White space of the word rules for DuckDB's regular expressions.
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
m AS (
  SELECT doc_id, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(ls)::BIGINT AS n_lines, coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0)::BIGINT AS longest_word FROM w),
g AS (SELECT doc_id, i, ws[i:i + 2] AS gram FROM m, unnest(range(1, n_words - 1)) AS r(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
q AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM d, unnest([0, 1, 2]) AS o(j) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(q.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN q USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN longest_word > 1000 THEN 64 ELSE 0 END)::BIGINT AS rule_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, longest_word, rule_bits,
  (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept, 2 AS policy
FROM b
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS gram
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 85 * (x.n + y.n - o.c)),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

OP10_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_ledger": OP2_SQL, "op6_warc_chunks": OP6_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op10_exact_dedup": OP10_SQL}

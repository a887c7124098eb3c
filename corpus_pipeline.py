"""A training corpus from documents: language, exact copies, near copies, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns what goes on; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rayline.llm.bpe import bpe_encode
from rayline.llm.exact_dedup import drop_exact_copies
from rayline.llm.language_id import fit, keep_identified
from rayline.llm.mixing import mixed_documents
from rayline.llm.ngram_join import Law, drop_near_copies

#: A text whose language has a smaller posterior than this cannot be told apart, and is rejected.
LEAST_SCORE = 0.5
#: Near copies share 80 % of their distinct shingles of five words.
NEAR = Law(words=5, num=80, den=100)
#: Sources, by code point, weigh these in turn; no document is taken more often than the cap.
WEIGHTS, CAP = (1, 2, 3), 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as their `lang`, whatever their label was.

    The model is fitted on a bounded sample of the labels.  Rejected are null and empty texts, texts without a letter,
    and those whose language is less likely than LEAST_SCORE; of equally likely ones the label that sorts first counts.
    Rows are judged one by one over their whole texts, so repeated rows and identifiers are judged alike.  Where no
    document has a label, all texts with a letter go on as they are.  Other columns stay; an empty table stays empty.
    """
    return keep_identified(docs, fit(docs), LEAST_SCORE, lang_col="lang")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the one of the smallest identifier.

    Null and empty texts are one group.  Rows without an identifier come last in a group; of rows that repeat both
    identifier and text one stays.  Texts of any length are compared whole.  Other columns stay, whatever their names,
    and an empty table stays empty.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one of the smallest identifier.

    Null and empty texts link with nothing and stay, and so do rows without an identifier.  Where identifiers repeat,
    rows are told apart by their texts, and one row of a component stays.  Texts of any length are one set of shingles.
    Other columns stay, whatever their names, and an empty table stays empty.
    """
    return drop_near_copies(docs, NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as came in, by source weight: each document as often as the mix takes it, shard after shard.

    A null source is the last one; null and empty texts have no words.  Rows that repeat an identifier, or have none,
    are taken alike.  A text of any length is one row.  Other columns stay, whatever their names, and an empty table
    stays empty.
    """
    return mixed_documents(docs, WEIGHTS, CAP)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, with the texts decoded from them as digests; repeats stay.

    Null and empty texts have no ids.  Texts are coded whole, row by row; other columns are not read, and an empty
    table gives no rows.
    """
    import public_tokenizers

    coded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Language models and tokenizers are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A stage's table is deleted once the next one is written, the last when the driver ends.
    """
    from uuid import uuid4

    from rayline.llm.common import remove, remove_at_end, shared_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home, before = f"{shared_dir(spark)}/pipeline-{uuid4().hex}", None
    remove_at_end(spark, home)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{home}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

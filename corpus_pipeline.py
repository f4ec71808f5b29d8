"""From raw documents to token ids: five stages, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir) and decides by what it finds in `docs`.
All but the last return the columns of `docs`, whatever else these are called.
Stage outputs are written as Parquet and read again, which cuts the lineage.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows and empty tables; an empty table stays empty.  What each does with the other
cases is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, decontaminate, neardup, pii, quality
from lumenframe.llm._common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below 0.3; the model learns from the labelled ones among `docs`.

    Null and empty texts get the score of a text without words; very long ones count whole; repeated rows share a fate;
    without labels of both classes all rows score alike, and stay unless all labels are 0.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group linked at 0.8 on five-word shingles.

    Rows without a word or without a doc_id are in no group and stay; of rows that repeat a doc_id and its text the first by
    the other columns stays; unlike texts under one doc_id are documents of their own.
    """
    return neardup.keep_one(docs, n=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of a benchmark item's five-word shingles.

    Null and empty texts hold nothing and stay; an item of fewer than five words counts as one shingle of its own length;
    null and empty items are in nothing; repeated rows share a fate.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind, and brings n_chars, where there is one, up to date.

    Null and empty texts stay as they are (n_chars of a null text becomes null); no row goes.
    """
    return pii.redact_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every remaining text.

    A null text counts as the empty one, which has no tokens; a null doc_id stays null; repeated rows give equal rows.
    """
    return bpe.round_trip(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", token_ids),
]

#: Learned scores and token ids have no SQL; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

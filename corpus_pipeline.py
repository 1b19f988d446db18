"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. Stages that learn do so from the tables below sf_dir and the same bounded samples
as their operators' queries, never from held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, near, packing, substring_dedup, toxicity
from tidemark.llm.common import cut
from tidemark.llm.queries import table, word_vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in no one language that was learned, go."""
    return langid.keep(docs, langid.train(table(spark, sf_dir, "documents")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more the one with the smallest id stays."""
    return near.keep_first(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window that also starts in an earlier document are removed."""
    return substring_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed into windows of 2048."""
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", first_of_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed),
]

#: SQL can express neither the trained models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in
the checkpoint folder and reads it again as the next stage's documents. All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nightwarden.llm import line_dedup, mixing, near_texts, packing, quality_rules
from nightwarden.session import checkpointed

CAPACITY, END_ID = 2048, 0


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps; NULL, empty and blank texts go, as they have too few words."""
    return quality_rules.filtered(docs, quality_rules.PRODUCTION)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier, exactly or nearly; those left without a word go."""
    return line_dedup.deduplicated(docs, drop_emptied=True).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    NULL and blank texts are copies of each other; a NULL id stays only where its group has no
    other (`near_texts`).
    """
    return near_texts.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a NULL source is one of its own, texts without words are not taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences; a NULL text is its end id alone."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality rules", keep_by_rules),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: Tokenising and SimHash are beyond SQL; tests compare `run` with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus in five stages: quality rules, line dedup, near duplicates, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wrenchbook.llm import decontaminate, jaccard_join, line_dedup, piece_codec, quality_ratio
from wrenchbook.llm.shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones."""
    return quality_ratio.keep(docs, quality_ratio.fit(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages and chunks of lines that stand in an earlier place; documents that lose all their words go."""
    return line_dedup.keep_worded(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return jaccard_join.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as piece numbers, with what these are decoded to as the text."""
    return piece_codec.decode(piece_codec.encode(docs, carry=True).drop("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", no_benchmark),
    ("SentencePiece encoding and decoding", pieces),
]

#: Hash buckets, alignments and segmentations are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)

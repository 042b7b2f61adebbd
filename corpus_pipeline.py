"""The corpus pipeline: quality, near duplicates, repeated substrings, benchmark contamination, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of docs, for the rows that
it keeps; the last the mixing operator's columns for the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, jaccard, mixing, quality, suffix_dedup
from lorekeep.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line chain, learned from labels outside the held-out fifth, predicts to be good."""
    return quality.stage(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that links of similarity 0.75 or more hold together."""
    return jaccard.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every 100-byte string that stands earlier in what is left, and drops texts of which nothing stays."""
    return suffix_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or a whole shorter item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL cannot say what a trained classifier keeps or what balanced sampling draws; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

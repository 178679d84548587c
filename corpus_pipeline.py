"""From documents to packed sequences, one operator a stage.

Every stage works on all rows its predecessor kept and carries all columns of
documents, also others that are named like its own.  Rows are told apart by
themselves: repeated rows, rows that share an id, and rows without one are
judged one by one, except where a stage says otherwise.  Texts are taken whole,
however long; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurelens.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from lurelens.llm.queries import tokenizer_path
from lurelens.llm.scratch import Scratch


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts fail them; null languages and sources form groups of their own."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, that with the smallest id stays.

    Of several rows of that id one stays; null and empty texts link with nothing; rows without an id stay.
    """
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first and are cut elsewhere.

    First is the smallest id, then row, then place; null ids come last; null and short texts stay as they are; n_chars follows.
    """
    return suffix_dedup.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts on either side overlap nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences of at most 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_poor),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what its predecessor wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

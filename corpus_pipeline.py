"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import compact_windows, jaccard_join, packing, pii_crf, quality_rules
from rasterlake.llm.common import WORKER_MEMORY, lean_workers, read_table, written  # noqa: F401

#: No stage after the first can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """``stage`` with workers that give memory back, also where stages are run by themselves."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean_workers(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@lean
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    return quality_rules.kept_documents(docs)


@lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words a shingle, similarity 0.8 or more."""
    return jaccard_join.representatives(docs, size=5, percent=80)


@lean
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut."""
    return compact_windows.without_passages(docs)


@lean
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii_crf.redacted(docs)


@lean
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences: null and empty texts are one piece, no rows give no rows."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before returned, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage is given rows that are written, so what earlier stages wrote on their way is no longer read: each stage drops it when it
starts. Null ids and texts, empty and very long texts, repeated rows, ties, empty tables and further columns with any name have the
results that the docstrings of the operators define; every stage but the last returns the columns it was given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from qaspark.llm.decontaminate import Decontamination
from qaspark.llm.exact import StreamingExactDedup
from qaspark.llm.packing import BestFitPacking
from qaspark.llm.queries import table, tokenizer_path
from qaspark.llm.simhash import NearDuplicates
from qaspark.llm.toxicity import Toxicity
from qaspark.session import cut, drop_tables, scratch

# The stages learn, hash and tokenise; SQL cannot say them. tests/llm/test_pipeline.py checks each by brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(run_stage: Stage) -> Stage:
    """Remembers the tables that a stage writes on its way and drops those of the stages before it."""

    @wraps(run_stage)
    def on_written_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _left)
        with scratch() as paths:
            kept = run_stage(spark, docs, sf_dir)
        _left.extend(paths)
        return kept

    return on_written_rows


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the score learns from ``labels``."""
    scorer = Toxicity()
    return scorer.reject(docs, scorer.fit(docs, table(spark, sf_dir, "labels")))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of those that are equal without white space."""
    return StreamingExactDedup().keep(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group with a similarity of 0.8 or more over five-word shingles."""
    return NearDuplicates().keep_first(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return Decontamination().remove(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of at most 2048 tokens."""
    return BestFitPacking(tokenizer_path("word_bpe_49k.json"))(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, run_stage in STAGES:
        with scratch() as result:
            docs = cut(run_stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, before)
        before = result
    drop_tables(spark, _left)
    return docs

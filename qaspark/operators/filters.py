"""Grade filters and review-list filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions.text import first_filled
from qaspark.operators.base import join_small
from qaspark.operators.expand import optional
from qaspark.schemas import GRADE_FIELDS


@dataclass(frozen=True)
class GradeFilter:
    """Keeps rows whose grades reach every threshold given; a missing grade counts as 0."""

    min_question_quality: float | None = 3.0
    min_answer_alignment: float | None = None
    min_answer_verifiability: float | None = None
    min_downstream_value: float | None = None

    @classmethod
    def all_at(cls, score: float) -> GradeFilter:
        """One threshold for all four dimensions."""
        return cls(score, score, score, score)

    def __call__(self, df: DataFrame) -> DataFrame:
        limits = (
            self.min_question_quality,
            self.min_answer_alignment,
            self.min_answer_verifiability,
            self.min_downstream_value,
        )
        for name, limit in zip(GRADE_FIELDS, limits):
            if limit is not None:
                grade = F.col(name) if name in df.columns else F.lit(0.0)
                df = df.filter(F.coalesce(grade, F.lit(0.0)) >= limit)
        return df


def review_flag(df: DataFrame, min_score: float) -> Column:
    """The lenient pass flag of the review list: a missing grade passes."""
    flag = F.lit(True)
    for name in GRADE_FIELDS:
        if name in df.columns:
            flag = flag & ~F.coalesce(F.col(name) < min_score, F.lit(False))
    return flag


def review_list(items: DataFrame, which: str = "all", search: str = "") -> DataFrame:
    """Items shown in the list: not deleted, passed or flagged, question containing ``search`` in any case."""
    shown = items.filter(~F.coalesce("deleted", F.lit(False)))
    is_false = F.coalesce(~F.col("filter_passed"), F.lit(False))
    if which == "passed":
        shown = shown.filter(~is_false)
    elif which == "flagged":
        shown = shown.filter(is_false)
    if search:
        question = F.lower(F.coalesce("question", F.lit("")))
        shown = shown.filter(F.contains(question, F.lower(F.lit(search))))
    return shown


def export_scope(items: DataFrame, scope: str = "passed", ids: DataFrame | None = None) -> DataFrame:
    """Items to export: deleted ones never, failed ones not under ``passed``; ``selected`` needs a list of ids."""
    rows = items.filter(~F.coalesce("deleted", F.lit(False)))
    if scope == "passed":
        rows = rows.filter(F.coalesce("filter_passed", F.lit(True)))
    if scope == "selected" and ids is not None:
        keys = [c for c in ("session_id", "id") if c in ids.columns]
        rows = join_small(rows, ids.select(*keys).distinct(), keys, "left_semi")
    return rows


def final_pair(df: DataFrame) -> tuple[Column, Column]:
    """Question and answer to export: the expanded text where filled, each on its own."""
    return (
        first_filled(optional(df, "expanded_question"), F.col("question")),
        first_filled(optional(df, "expanded_answer"), F.col("answer")),
    )


def overall_score(df: DataFrame) -> Column:
    """Mean of the grades present, null when there is none (our definition)."""
    grades = F.filter(F.array(*[F.col(g) for g in GRADE_FIELDS]), lambda g: g.isNotNull())
    total = F.aggregate(grades, F.lit(0.0), lambda acc, g: acc + g)
    return F.when(F.size(grades) > 0, total / F.size(grades))

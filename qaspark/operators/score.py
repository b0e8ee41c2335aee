"""Four-dimension scoring of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.operators import prompts as P
from qaspark.operators.generation import Ask, Generator
from qaspark.operators.language import language_instruction, normalize_language
from qaspark.schemas import DIMENSIONS


def score_prompt(dimension: str, language: str) -> Column:
    return P.SCORE.render(
        task=P.SCORE_TASKS[dimension],
        language=language_instruction(language),
        context=F.col("chunk_text"),
        question=F.col("question"),
        answer=F.col("answer"),
    )


@dataclass(frozen=True)
class ScoreQA:
    """Adds a grade and a feedback text per dimension.

    The four calls become four columns of the row: nothing is exploded, so nothing has to be pivoted
    back and no shuffle is needed.
    """

    generator: Generator
    target_language: str = "zh"
    system_prompt: str = ""

    def __post_init__(self) -> None:
        normalize_language(self.target_language)

    def __call__(self, df: DataFrame) -> DataFrame:
        asks = [Ask(d, score_prompt(d, self.target_language), self.system_prompt, f"_{d}") for d in DIMENSIONS]
        asked = self.generator.ask_all(df, asks)
        parsed = {}
        for d in DIMENSIONS:
            parsed[f"{d}_grade"] = J.grade(F.col(f"_{d}"))
            parsed[f"{d}_feedback"] = J.feedback(F.col(f"_{d}"))
        return asked.withColumns(parsed).drop(*[a.to for a in asks])

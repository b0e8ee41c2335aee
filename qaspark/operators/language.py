"""Target language of prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from qaspark.functions.text import py_lower_strip
from qaspark.operators.base import require

# Supported languages (fixed values) and the sentence each one puts into prompts.
INSTRUCTIONS = {
    "zh": "请全部用中文书写。",
    "en": "Write everything in English.",
    "auto": "Write in the language that most of the passage is in.",
}


def normalize_language(language: str) -> str:
    value = language.strip().lower()
    require(value in INSTRUCTIONS, "target_language must be one of: zh, en, auto")
    return value


def language_instruction(language: str) -> str:
    return INSTRUCTIONS[normalize_language(language)]


def language_column(language: Column) -> tuple[Column, Column]:
    """Normalised language and its instruction for a language per row; unsupported values give null."""
    value = py_lower_strip(language)
    known = F.when(value.isin(*INSTRUCTIONS), value)
    table = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    return known, F.element_at(table, known)

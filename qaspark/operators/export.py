"""Training-record shapes and their JSON Lines sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from qaspark.functions.text import is_blank
from qaspark.operators.base import require
from qaspark.operators.filters import export_scope, final_pair
from qaspark.sources.jsonl import write_jsonl

# Instruction sentences of the three export shapes.
ALPACA_INSTRUCTION = "Please answer the following question based on the provided information."
MULTIHOP_INSTRUCTION = "Answer the multi-hop question using the provided supporting facts."
SESSION_INSTRUCTION = "根据给定上下文回答问题。"
_TAXONOMY_FIELDS = ("level1_name", "level2_name", "task_type", "reasoning_style")
_SESSION_FIELDS = ("source_md", "chunk_index", "think", "level1_name", "task_type", "hop_type")


@dataclass(frozen=True)
class AlpacaExport:
    """Flat instruction records; ``think`` and the taxonomy names appear when the table has them."""

    instruction: str = ALPACA_INSTRUCTION
    path: str | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        question, answer = final_pair(df)
        extra = [c for c in ("think", *_TAXONOMY_FIELDS) if c in df.columns]
        records = df.select(
            F.lit(self.instruction).alias("instruction"),
            question.alias("input"),
            answer.alias("output"),
            "source_md",
            "chunk_index",
            *extra,
        )
        if self.path:
            write_jsonl(records, self.path)
        return records


@dataclass(frozen=True)
class MultiHopExport:
    """Instruction records with a nested ``metadata`` object."""

    instruction: str = MULTIHOP_INSTRUCTION
    path: str | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        no_steps = F.array().cast("array<struct<step:string>>")
        metadata = F.struct(
            F.coalesce("reasoning_steps", no_steps).alias("reasoning_steps"),
            F.coalesce("supporting_facts", F.array().cast("array<string>")).alias("supporting_facts"),
            F.coalesce("qa_type", F.lit("")).alias("type"),
            F.coalesce(F.col("complexity") if "complexity" in df.columns else F.lit(None), F.lit(0.0)).alias("complexity"),
        )
        records = df.select(
            F.lit(self.instruction).alias("instruction"),
            F.col("question").alias("input"),
            F.col("answer").alias("output"),
            "source_md",
            "chunk_index",
            metadata.alias("metadata"),
        )
        if self.path:
            write_jsonl(records, self.path)
        return records


# Names of speakers and fields in the two chat shapes.
_CHAT_SHAPES = {
    "sharegpt": ("conversations", "from", "value", {"system": "system", "user": "human", "assistant": "gpt"}),
    "chatml": ("messages", "role", "content", {"system": "system", "user": "user", "assistant": "assistant"}),
}


@dataclass(frozen=True)
class ChatExport:
    """Question and answer as turns of a chat, in one of two common shapes; ``system`` adds a first turn.

    With ``context`` the passage stands before the question. Records without a question or an answer are left out.
    """

    shape: str = "chatml"
    system: str = ""
    context: bool = False
    path: str | None = None

    def __post_init__(self) -> None:
        require(self.shape in _CHAT_SHAPES, f"shape must be one of: {', '.join(_CHAT_SHAPES)}")

    def __call__(self, df: DataFrame) -> DataFrame:
        turns, who, what, names = _CHAT_SHAPES[self.shape]
        question, answer = final_pair(df)
        asked = F.concat(F.coalesce("chunk_text", F.lit("")), F.lit("\n\n"), question) if self.context else question
        said = [("user", asked), ("assistant", answer)]
        if self.system:
            said.insert(0, ("system", F.lit(self.system)))
        chat = F.array(*[F.struct(F.lit(names[speaker]).alias(who), text.alias(what)) for speaker, text in said])
        filled = ~is_blank(question) & ~is_blank(answer)
        records = df.filter(filled).select(chat.alias(turns), "source_md", "chunk_index")
        if self.path:
            write_jsonl(records, self.path)
        return records


def session_export(items: DataFrame, scope: str = "passed", ids: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Export of review items: final pair plus the fields that are present."""
    rows = export_scope(items, scope, ids)
    question, answer = final_pair(rows)
    records = rows.select(
        F.lit(SESSION_INSTRUCTION).alias("instruction"),
        F.coalesce(question, F.lit("")).alias("input"),
        F.coalesce(answer, F.lit("")).alias("output"),
        *[F.col(c) for c in _SESSION_FIELDS if c in rows.columns],
    )
    if path:
        write_jsonl(records, path)
    return records



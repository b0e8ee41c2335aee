"""Atomic questions: facts of a chunk turned into questions that only the chunk can answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.functions.text import is_blank, token_f1
from qaspark.operators import prompts as P
from qaspark.operators.base import LimitPerChunk, entries, read_fields, require
from qaspark.operators.generation import Ask, Generator
from qaspark.operators.singlehop import plain_record


def closed_book_failed(score: Column) -> Column:
    """Keep rule of the closed-book check: an unreadable score drops the row."""
    return F.coalesce(score < 1, F.lit(False))


def open_book_succeeded(score: Column) -> Column:
    return F.coalesce(score >= 1, F.lit(False))


def with_candidates(df: DataFrame, response: str, max_per_task: int, to: str = "candidates") -> DataFrame:
    """Facts of a response as ``array<struct<conclusion, R>>``.

    The list is cut to ``max_per_task`` before incomplete entries are dropped; a lone object counts as
    a list of one.
    """
    parsed = df.withColumn("_v", J.strict_json(J.clean_json_block(F.col(response))))
    listed = F.when(J.is_object(F.col("_v")), F.array("_v")).otherwise(J.items(F.col("_v")))
    tasks = F.transform(
        F.filter(F.slice(listed, 1, max_per_task), J.is_object),
        lambda x: F.struct(J.text_of(x, "conclusion").alias("conclusion"), J.text_of(x, "R").alias("R")),
    )
    return parsed.withColumn(to, F.filter(tasks, lambda t: (t.conclusion != "") & (t.R != ""))).drop("_v")


def optional_answers(value: Column, refined: Column) -> Column:
    """Listed alternatives of a parsed response, or the refined answer alone."""
    nothing = F.array().cast("array<string>")
    return F.when(refined == "", nothing).when(J.is_array(value), J.text_items(value)).otherwise(F.array(refined))


@dataclass(frozen=True)
class AtomicQA:
    """Cheap and selective checks come first: closed book, then open book, then alternatives."""

    generator: Generator
    max_per_task: int = 10
    max_question: int = 10
    input_key: str = "chunk_text"

    def __post_init__(self) -> None:
        require(self.max_per_task > 0 and self.max_question > 0, "max_per_task and max_question must be positive")

    def _ask(self, df: DataFrame, stage: str, prompt: Column, system: str, to: str) -> DataFrame:
        asked = self.generator.ask(df, stage, prompt, system)
        return asked.withColumn(to, F.col("response")).drop("response", "gen_status", "gen_error")

    def _field(self, df: DataFrame, stage: str, prompt: Column, system: str, key: str, to: str) -> DataFrame:
        """Ask, read one text member of the JSON answer, drop rows where it is blank."""
        asked = self._ask(df, stage, prompt, system, "_r")
        parsed = asked.withColumn("_v", J.json_object(F.col("_r")))
        return read_fields(parsed, {to: J.text_of(F.col("_v"), key)}, lambda r: r[to] != "").drop("_r", "_v")

    def _recall(self, df: DataFrame, stage: str, other: str, to: str, keep: Callable[[Column], Column]) -> DataFrame:
        prompt = P.RECALL.render(golden=F.col("refined_answer"), other=F.col(other))
        asked = self._ask(df, stage, prompt, P.RECALL_SYSTEM, "_r")
        return read_fields(asked, {to: J.recall_score(F.col("_r"))}, lambda r: keep(r[to])).drop("_r")

    def __call__(self, df: DataFrame) -> DataFrame:
        base = df.columns
        text = F.col(self.input_key)
        chunks = df.filter(~is_blank(text))
        facts = self.generator.ask_all(
            chunks,
            [
                Ask("identifier", P.IDENTIFIER.render(text=text), P.IDENTIFIER_SYSTEM, "_id"),
                Ask("conclusions", P.CONCLUSIONS.render(text=text), P.CONCLUSIONS_SYSTEM, "_facts"),
            ],
        )
        tasks = (
            with_candidates(facts, "_facts", self.max_per_task, "_tasks")
            .select(
                *base,
                J.content_identifier(F.col("_id")).alias("identifier"),
                F.posexplode(entries("_tasks")).alias("_i", "_task"),
            )
            .withColumns(
                {"candidate_tasks_str": F.to_json("_task"), "rec_ord": F.array("_i"), "answer": F.col("_task.conclusion")}
            )
        )
        questions = self._field(
            tasks,
            "atomic_question",
            P.ATOMIC_QUESTION.render(
                identifier=F.col("identifier"), conclusion=F.col("_task.conclusion"), relation=F.col("_task.R")
            ),
            P.ATOMIC_QUESTION_SYSTEM,
            "Q",
            "question",
        ).drop("_i", "_task")
        item = F.to_json(F.struct("question", F.col("answer").alias("original_answer")))
        refined = self._field(
            questions, "refine", P.ATOMIC_CLEAN.render(item=item), P.ATOMIC_CLEAN_SYSTEM, "refined_answer", "refined_answer"
        )
        closed = self._ask(refined, "closed_book", P.CLOSED_BOOK.render(question=F.col("question")), "", "llm_answer")
        closed = self._recall(closed, "closed_recall", "llm_answer", "llm_recall_score", closed_book_failed)
        opened = self._ask(
            closed, "open_book", P.OPEN_BOOK.render(text=text, question=F.col("question")), "", "golden_doc_answer"
        )
        opened = self._recall(
            opened, "open_recall", "golden_doc_answer", "golden_doc_recall_score", open_book_succeeded
        )
        listed = self._ask(
            opened, "alternatives", P.ALTERNATIVES.render(answer=F.col("refined_answer")), P.ALTERNATIVES_SYSTEM, "_r"
        )
        listed = listed.withColumn("_v", J.strict_json(J.clean_json_block(F.col("_r")))).withColumn(
            "optional_answer", optional_answers(F.col("_v"), F.col("refined_answer"))
        )
        limited = LimitPerChunk(self.max_question)(listed.drop("_r", "_v"))
        return limited.withColumns(
            {
                "golden_doc_f1": token_f1(F.col("golden_doc_answer"), F.col("optional_answer")),
                "original_answer": F.col("answer"),
                "answer": F.col("refined_answer"),
                "context": F.coalesce("chunk_text", F.lit("")) if "chunk_text" in base else F.lit(""),
                **plain_record("singlehop", F.lit("atomic")),
            }
        )

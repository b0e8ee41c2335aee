"""Expansion of pairs and added reasoning; the original fields stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.functions.text import first_filled
from qaspark.operators import prompts as P
from qaspark.operators.base import require
from qaspark.operators.generation import Generator
from qaspark.operators.language import language_instruction, normalize_language


def optional(df: DataFrame, name: str) -> Column:
    """A column that may be absent from the table, as null."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def grounding(df: DataFrame) -> Column:
    """Context of a record, else its chunk text, else empty."""
    return first_filled(optional(df, "context"), optional(df, "chunk_text"), F.lit(""))


# Why a response cannot be used, in our words.
NO_OBJECT = "the {} response holds no JSON object"
INCOMPLETE = "the expansion lacks its question or its answer"


def _error(what: str, missing: Column | None = None) -> Column:
    """Why a response could not be used; needs ``response`` and the parsed ``_v``."""
    tail = J.json_object_tail(F.col("response"))
    reason = F.when(tail.isNull(), F.lit(NO_OBJECT.format(what))).when(
        F.col("_v").isNull(), F.lit(f"{what.capitalize()} response is not one valid JSON object")
    )
    return reason if missing is None else reason.when(
        missing, F.lit(INCOMPLETE)
    )


@dataclass(frozen=True)
class ExpandQA:
    """Expanded question and answer with a status; failed rows are kept unless ``keep_failed`` is off."""

    generator: Generator
    mode: str = "detail"
    target_language: str = "zh"
    keep_failed: bool = True
    system_prompt: str | None = None

    def __post_init__(self) -> None:
        require(self.mode in P.EXPANSION_MODES, "mode must be one of: detail, contextual, reasoning")
        normalize_language(self.target_language)

    def __call__(self, df: DataFrame) -> DataFrame:
        prompt = P.EXPAND.render(
            language=language_instruction(self.target_language),
            mode=self.mode,
            hint=P.EXPANSION_HINTS[self.mode],
            context=grounding(df),
            question=F.col("question"),
            answer=F.col("answer"),
        )
        system = P.grounded_system("You expand question/answer pairs.", self.target_language, self.system_prompt)
        parsed = self.generator.ask(df, "expand", prompt, system).withColumn(
            "_v", J.json_tail_object(F.col("response"))
        )
        fields = parsed.withColumns(
            {
                "_q": J.text_of(F.col("_v"), "expanded_question"),
                "_a": J.text_of(F.col("_v"), "expanded_answer"),
                "_t": J.text_of(F.col("_v"), "expansion_type"),
                "_n": J.text_of(F.col("_v"), "expansion_notes"),
            }
        )
        incomplete = (F.col("_q") == "") | (F.col("_a") == "")
        judged = fields.withColumn("expansion_error", _error("expansion", incomplete))
        ok = F.col("expansion_error").isNull()

        def on_success(value: Column, name: str) -> Column:
            return F.when(ok, value).otherwise(optional(df, name))

        out = judged.withColumns(
            {
                "expanded_question": on_success(F.col("_q"), "expanded_question"),
                "expanded_answer": on_success(F.col("_a"), "expanded_answer"),
                "expansion_type": on_success(first_filled(F.col("_t"), F.lit(self.mode)), "expansion_type"),
                "expansion_notes": on_success(F.col("_n"), "expansion_notes"),
                "expansion_status": F.when(ok, F.lit("ok")).otherwise(F.lit("failed")),
            }
        ).drop("_v", "_q", "_a", "_t", "_n", "response", "gen_status", "gen_error")
        return out if self.keep_failed else out.filter(F.col("expansion_status") == "ok")


@dataclass(frozen=True)
class ThinkQA:
    """Adds ``think`` and rebuilds the final answer; the answer it replaces is kept once as the original."""

    generator: Generator
    target_language: str = "zh"
    keep_failed: bool = True
    system_prompt: str | None = None

    def __post_init__(self) -> None:
        normalize_language(self.target_language)

    def __call__(self, df: DataFrame) -> DataFrame:
        expanded_q, expanded_a = optional(df, "expanded_question"), optional(df, "expanded_answer")
        # the expanded pair is the final one as soon as either half is filled
        use_expanded = (F.coalesce(expanded_q, F.lit("")) != "") | (F.coalesce(expanded_a, F.lit("")) != "")
        final_q = F.when(use_expanded, expanded_q).otherwise(F.col("question"))
        final_a = F.when(use_expanded, expanded_a).otherwise(F.col("answer"))
        prompt = P.THINK.render(
            language=language_instruction(self.target_language), context=grounding(df), question=final_q, answer=final_a
        )
        system = P.grounded_system(
            "You add a short chain of thought to question/answer pairs.", self.target_language, self.system_prompt
        )
        parsed = self.generator.ask(df, "think", prompt, system).withColumn("_v", J.json_tail_object(F.col("response")))
        fields = parsed.withColumns(
            {
                "think_error": _error("think"),
                "_think": J.filled_text_of(F.col("_v"), "think"),
                "_new": J.filled_text_of(F.col("_v"), "answer"),
                "_expanded": use_expanded,
            }
        )
        ok = F.col("think_error").isNull()
        to_expanded, to_plain = ok & F.col("_expanded"), ok & ~F.col("_expanded")

        def backup(target: Column, name: str, value: Column) -> Column:
            earlier = optional(df, name)
            return F.coalesce(earlier, F.when(target, F.coalesce(value, F.lit(""))))

        def rebuilt(target: Column, old: Column) -> Column:
            return F.when(target, first_filled(F.col("_new"), F.coalesce(old, F.lit("")))).otherwise(old)

        changed = {
            "think": F.when(ok, F.col("_think")).otherwise(F.lit("")),
            "think_status": F.when(ok, F.lit("ok")).otherwise(F.lit("failed")),
            "original_expanded_answer": backup(to_expanded, "original_expanded_answer", expanded_a),
            "original_answer": backup(to_plain, "original_answer", F.col("answer")),
            "answer": rebuilt(to_plain, F.col("answer")),
        }
        if {"expanded_question", "expanded_answer"} & set(df.columns):
            changed["expanded_answer"] = rebuilt(to_expanded, expanded_a)
            changed["expanded_question"] = F.when(to_expanded, F.coalesce(expanded_q, F.lit(""))).otherwise(expanded_q)
        out = fields.withColumns(changed).drop(
            "_v", "_think", "_new", "_expanded", "response", "gen_status", "gen_error"
        )
        return out if self.keep_failed else out.filter(F.col("think_status") == "ok")

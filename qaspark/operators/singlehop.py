"""Single-hop question generation: chunk -> instructions -> pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.functions.text import WS, is_blank, py_strip
from qaspark.operators import prompts as P
from qaspark.operators.base import LimitPerChunk, require
from qaspark.operators.generation import Generator
from qaspark.operators.language import normalize_language
from qaspark.schemas import STEPS

# Characters that end a line in a response.
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def prompt_list(response: Column) -> Column:
    """Non-blank strings of a JSON list; a bracketed text that is no JSON is cut at commas; else empty."""
    text = J.clean_json_block(response)
    value = J.strict_json(text)
    inner = py_strip(F.substring(text, F.lit(2), F.length(text) - 2))
    unquoted = F.transform(
        F.filter(F.split(inner, ","), lambda p: py_strip(p) != ""),
        lambda p: F.btrim(F.btrim(py_strip(p), F.lit('"')), F.lit("'")),
    )
    bracketed = text.startswith("[") & text.endswith("]") & (inner != "")
    nothing = F.array().cast("array<string>")
    return F.when(value.isNotNull(), J.text_items(value)).when(bracketed, unquoted).otherwise(nothing)


def _pair(question: Column, answer: Column) -> Column:
    return F.struct(question.alias("question"), answer.alias("answer"))


def _both(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: (p.question != "") & (p.answer != ""))


def json_pairs(value: Column) -> Column:
    """Pairs under ``qa_pairs`` of a parsed object, with their synonyms; incomplete ones are dropped."""
    found = J.items(J.member(value, "qa_pairs"))
    return _both(
        F.transform(
            F.filter(found, J.is_object),
            lambda x: _pair(
                J.filled_text_of(x, "input", "question", "instruction"), J.filled_text_of(x, "output", "answer")
            ),
        )
    )


def _last_line_after(response: Column, mark: str) -> Column:
    lines = F.transform(F.split(py_strip(response), _LINE_END), py_strip)
    marked = F.filter(lines, lambda line: F.lower(F.left(line, F.lit(2))) == f"{mark}:")
    last = F.get(marked, F.size(marked) - 1)
    return F.coalesce(py_strip(F.substr(last, F.lit(3))), F.lit(""))


def line_pair(response: Column) -> Column:
    """The last ``Q:`` and the last ``A:`` line as a list of at most one pair."""
    return _both(F.array(_pair(_last_line_after(response, "q"), _last_line_after(response, "a"))))


def with_pairs(df: DataFrame, to: str = "pairs") -> DataFrame:
    """Add the pairs of ``response``: from its JSON object, else from its lines.

    The parsed object and its pairs are columns of their own, so each response is parsed once.
    """
    parsed = df.withColumn("_v", J.json_tail_object(F.col("response"))).withColumn("_found", json_pairs(F.col("_v")))
    return parsed.withColumn(
        to, F.when(F.size("_found") > 0, F.col("_found")).otherwise(line_pair(F.col("response")))
    ).drop("_v", "_found")


def plain_record(hop_type: str, qa_type: Column) -> dict[str, Column]:
    """Fields every single-hop record carries."""
    return {
        "hop_type": F.lit(hop_type),
        "reasoning_steps": F.array().cast(STEPS),
        "supporting_facts": F.array().cast("array<string>"),
        "qa_type": qa_type,
    }


@dataclass(frozen=True)
class SingleHopQA:
    """Two model calls per chunk: instructions for extraction, then pairs for the first ``question_num`` of them."""

    generator: Generator
    question_num: int = 1
    target_language: str = "zh"
    system_prompt: str = ""

    def __post_init__(self) -> None:
        require(self.question_num > 0, "question_num must be positive")
        normalize_language(self.target_language)

    def __call__(self, df: DataFrame) -> DataFrame:
        base = df.columns
        chunks = df.filter(~is_blank(F.col("chunk_text")))
        asked = self.generator.ask(
            chunks,
            "instructions",
            P.META_PROMPT.render(amount=P.meta_amount(self.question_num), chunk=F.col("chunk_text")),
        )
        instructions = asked.select(
            *base,
            F.posexplode(F.slice(prompt_list(F.col("response")), 1, self.question_num)).alias("_i", "generated_prompt"),
        )
        answered = self.generator.ask(
            instructions,
            "pairs",
            P.SEED_PROMPT.render(instruction=F.col("generated_prompt"), chunk=F.col("chunk_text")),
            self.system_prompt,
        )
        # one instruction can give at most question_num rows of its chunk, so longer lists are cut
        # inside the row and the shuffle of the limit carries no surplus
        pairs = F.slice("_pairs", 1, self.question_num)
        rows = (
            with_pairs(answered, "_pairs")
            .select(*base, "generated_prompt", "_i", F.posexplode(pairs).alias("_j", "_p"))
            .select(*base, "generated_prompt", F.array("_i", "_j").alias("rec_ord"), "_p.*")
        )
        # the context repeats the chunk text, so it is added after the shuffle
        return LimitPerChunk(self.question_num)(rows).withColumns(
            {"context": F.col("chunk_text"), **plain_record("singlehop", F.lit("text2qa_meta"))}
        )

"""Taxonomy-guided questions: tag chunks, ask per tag, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.functions.text import is_blank
from qaspark.operators import prompts as P
from qaspark.operators.base import entries, join_small, read_fields
from qaspark.operators.exchange import ROW_KEY
from qaspark.operators.generation import Generator
from qaspark.operators.language import language_instruction, normalize_language
from qaspark.operators.singlehop import plain_record
from qaspark.schemas import TAGS
from qaspark.sources.taxonomy import Taxonomy, catalog_text

_TAG_FIELDS = ("level1_name", "level2_name", "task_type", "reasoning_style")


def raw_tags(value: Column) -> Column:
    """Tag objects of a parsed response with all four names filled, as ``array<struct>``."""
    tags = F.transform(
        F.filter(J.items(J.member(value, "tags")), J.is_object),
        lambda x: F.struct(*[J.filled_text_of(x, f).alias(f) for f in _TAG_FIELDS]),
    )
    return F.filter(
        tags,
        lambda t: (t.level1_name != "") & (t.level2_name != "") & (t.task_type != "") & (t.reasoning_style != ""),
    )


def attach_categories(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Inner join of tag rows with the category table; tags outside the table drop out.

    A key listed twice counts with its last entry. The table is broadcast only when counted small.
    """
    last = categories.groupBy("level1_name", "level2_name").agg(
        F.max_by("focus", "cat_ord").alias("focus"), F.max_by("prompt_hint", "cat_ord").alias("prompt_hint")
    )
    return join_small(tags, last, ["level1_name", "level2_name"], "inner")


def known_enums(tags: DataFrame, task_types: list[str], styles: list[str]) -> DataFrame:
    return tags.filter(F.col("task_type").isin(task_types) & F.col("reasoning_style").isin(styles))


def _lookup(taxonomy: Taxonomy) -> Column:
    """Category texts as one literal map. The catalogue stands in every prompt, so it is small by nature;
    as a literal it keeps the tag list inside its row: no explode, no join, no regrouping."""
    entries = {(c.level1_name, c.level2_name): c for c in taxonomy.categories}
    pairs: list[Column] = []
    for (level1, level2), c in entries.items():
        pairs.append(F.struct(F.lit(level1).alias("a"), F.lit(level2).alias("b")))
        pairs.append(F.struct(F.lit(c.focus).alias("focus"), F.lit(c.prompt_hint).alias("prompt_hint")))
    return F.create_map(*pairs)


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


@dataclass(frozen=True)
class TagChunks:
    """Adds ``taxonomy_tags`` and ``tag_status``.

    A response that is no JSON object gives no tags and the status ``failed``; with ``fail_fast`` it
    stops the job instead.
    """

    generator: Generator
    taxonomy: Taxonomy
    target_language: str = "zh"
    system_prompt: str = ""
    fail_fast: bool = False

    def __post_init__(self) -> None:
        normalize_language(self.target_language)

    def prompt(self) -> Column:
        full = P.TAXONOMY_TAGS.render(
            topic=self.taxonomy.topic,
            language=language_instruction(self.target_language),
            catalog=catalog_text(self.taxonomy),
            chunk=F.col("chunk_text"),
        )
        return F.when(is_blank(F.col("chunk_text")), F.lit(P.TAXONOMY_EMPTY)).otherwise(full)

    def __call__(self, df: DataFrame) -> DataFrame:
        asked = self.generator.ask(df, "tags", self.prompt(), P.with_json_rule(self.system_prompt))
        parsed = asked.withColumn("_v", J.json_tail_object(F.col("response")))
        if self.fail_fast:
            bad = F.raise_error(F.concat(F.lit("taxonomy tags must be a JSON object: "), F.col("response")))
            parsed = parsed.withColumn("_v", F.when(F.col("_v").isNull(), bad).otherwise(F.col("_v")))
        lookup = _lookup(self.taxonomy)
        known = F.filter(
            raw_tags(F.col("_v")),
            lambda t: t.task_type.isin(list(self.taxonomy.task_type))
            & t.reasoning_style.isin(list(self.taxonomy.reasoning_style)),
        )
        matched = F.transform(
            known,
            lambda t: F.struct(
                t.alias("t"), F.try_element_at(lookup, F.struct(t.level1_name.alias("a"), t.level2_name.alias("b"))).alias("c")
            ),
        )
        tags = F.transform(
            F.filter(matched, lambda m: m.c.isNotNull()),
            lambda m: F.struct(
                *[m.t[f].alias(f) for f in _TAG_FIELDS],
                m.c.focus.alias("focus"),
                m.c.prompt_hint.alias("prompt_hint"),
            ),
        )
        return parsed.select(
            *df.columns,
            tags.cast(TAGS).alias("taxonomy_tags"),
            F.when(F.col("_v").isNull(), F.lit("failed")).otherwise(F.lit("ok")).alias("tag_status"),
        )


@dataclass(frozen=True)
class TaxonomyQuestions:
    """One question per tag; the record is projected to a fixed set of fields."""

    generator: Generator
    taxonomy: Taxonomy
    target_language: str = "zh"
    system_prompt: str = ""

    def __call__(self, df: DataFrame) -> DataFrame:
        keys = [c for c in ("source_md", "chunk_index", ROW_KEY) if c in df.columns]
        tagged = df.select(*keys, "chunk_text", F.posexplode(entries("taxonomy_tags")).alias("_i", "_t"))
        rows = tagged.select(*keys, F.array("_i").alias("rec_ord"), "chunk_text", "_t.*")
        prompt = P.TAXONOMY_QUESTION.render(
            topic=self.taxonomy.topic,
            language=language_instruction(self.target_language),
            level1=F.col("level1_name"),
            level2=F.col("level2_name"),
            focus=F.col("focus"),
            hint=F.col("prompt_hint"),
            task=F.col("task_type"),
            task_text=F.try_element_at(_literal_map(self.taxonomy.task_type), F.col("task_type")),
            style=F.col("reasoning_style"),
            style_text=F.try_element_at(_literal_map(self.taxonomy.reasoning_style), F.col("reasoning_style")),
            chunk=F.col("chunk_text"),
        )
        asked = self.generator.ask(rows, "taxonomy_question", prompt, P.with_json_rule(self.system_prompt))
        parsed = asked.withColumn("_v", J.json_tail_object(F.col("response")))
        question = {"question": J.filled_text_of(F.col("_v"), "question")}
        return (
            read_fields(parsed, question, lambda r: r.question != "")
            .drop("_v", "response", "gen_status", "gen_error")
            .withColumns(
                {"context": F.col("chunk_text"), **plain_record("singlehop", F.col("task_type"))}
            )
        )


@dataclass(frozen=True)
class TaxonomyAnswers:
    generator: Generator
    taxonomy: Taxonomy
    target_language: str = "zh"
    system_prompt: str = 'Return one JSON object: {"answer": "..."}'

    def __call__(self, df: DataFrame) -> DataFrame:
        prompt = P.TAXONOMY_ANSWER.render(
            topic=self.taxonomy.topic,
            language=language_instruction(self.target_language),
            level1=F.col("level1_name"),
            level2=F.col("level2_name"),
            task=F.col("task_type"),
            style=F.col("reasoning_style"),
            question=F.col("question"),
            chunk=F.col("chunk_text"),
        )
        asked = self.generator.ask(df, "taxonomy_answer", prompt, P.with_json_rule(self.system_prompt))
        parsed = asked.withColumn("_v", J.json_tail_object(F.col("response")))
        answer = {"answer": J.filled_text_of(F.col("_v"), "answer")}
        return read_fields(parsed, answer, lambda r: r.answer != "").drop("_v", "response", "gen_status", "gen_error")

"""Depth questions (ever broader subjects) and width questions (adjacent questions merged)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.functions.text import first_filled, is_blank, let, py_strip
from qaspark.operators import prompts as P
from qaspark.operators.atomic import closed_book_failed
from qaspark.operators.base import entries, read_fields, require
from qaspark.operators.expand import optional
from qaspark.operators.generation import Generator
from qaspark.operators.ordering import dense_index

ANSWER_JOINT = "；"  # fixed value: joins the answers of merged questions
_ROUND = "struct<round:int,new_identifier:string,relation:string,question:string>"


def ask_and_read(
    generator: Generator,
    df: DataFrame,
    stage: str,
    prompt: Column,
    system: str,
    fields: Callable[[Column], dict[str, Column]],
    keep: Callable[[Column], Column] | None = None,
    parse: Callable[[Column], Column] = lambda response: response,
) -> DataFrame:
    """One model call; ``parse`` reads the response once, ``fields`` takes columns from what it gives."""
    asked = generator.ask(df, stage, prompt, system).withColumn("_v", parse(F.col("response")))
    return read_fields(asked, fields(F.col("_v")), keep).drop("_v", "response", "gen_status", "gen_error")


def fill_identifiers(df: DataFrame, generator: Generator) -> DataFrame:
    """``identifier`` kept where filled, else taken from a model response; only blank rows are asked."""
    known = optional(df, "identifier")
    blank = is_blank(known)
    prompt = F.when(blank, P.IDENTIFIER.render(text=F.col("question")))
    return ask_and_read(
        generator,
        df,
        "identifier",
        prompt,
        P.IDENTIFIER_SYSTEM,
        lambda r: {"identifier": F.when(blank, J.content_identifier(r)).otherwise(known)},
    )


def superset(v: Column) -> dict[str, Column]:
    return {"new_identifier": J.text_of(v, "identifier"), "relation": J.text_of(v, "relation")}


def superset_is_valid(v: Column) -> Column:
    """Exactly the text ``valid`` under ``new_query``."""
    verdict = J.member(v, "new_query")
    is_text = F.schema_of_variant(verdict) == "STRING"
    return F.coalesce(is_text & (F.try_variant_get(verdict, "$", "string") == "valid"), F.lit(False))


def golden_text(df: DataFrame) -> Column:
    """Refined answer if the row has one, else its answer."""
    return py_strip(F.coalesce(optional(df, "refined_answer"), optional(df, "answer"), F.lit("")))


@dataclass(frozen=True)
class DepthQA:
    """``n_rounds`` rounds; a row that fails a round is dropped with all its earlier rounds.

    Rounds are collected in an array and exploded at the end. ``verify`` names the question the
    closed-book check asks: the original one or the new one of the round.
    """

    generator: Generator
    n_rounds: int = 2
    verify: str = "original"

    def __post_init__(self) -> None:
        require(self.n_rounds > 0, "n_rounds must be positive")
        require(self.verify in ("original", "new"), "verify must be original or new")

    def _round(self, df: DataFrame, number: int) -> DataFrame:
        ask = self.generator
        here = F.col("_subject")
        rows = ask_and_read(
            ask, df, "superset", P.SUPERSET.render(identifier=here), P.SUPERSET_SYSTEM, superset,
            lambda r: (r.new_identifier != "") & (r.relation != ""), J.json_object,
        )
        links = {"superset": F.col("new_identifier"), "relation": F.col("relation"), "identifier": here}
        rows = ask_and_read(
            ask, rows, "superset_check", P.SUPERSET_CHECK.render(**links), P.SUPERSET_CHECK_SYSTEM,
            lambda v: {"_valid": superset_is_valid(v)}, lambda r: r["_valid"], J.json_object,
        ).drop("_valid")
        rows = ask_and_read(
            ask, rows, "depth_question", P.DEPTH_QUESTION.render(**links), P.DEPTH_QUESTION_SYSTEM,
            lambda v: {"_new_question": J.text_of(v, "new_query")}, lambda r: r["_new_question"] != "", J.json_object,
        )
        asked_question = F.col("question") if self.verify == "original" else F.col("_new_question")
        rows = ask_and_read(
            ask, rows, "depth_answer", P.DEPTH_ANSWER.render(question=asked_question), "", lambda r: {"llm_answer": r}
        )
        rows = ask_and_read(
            ask, rows, "depth_recall", P.RECALL.render(golden=golden_text(rows), other=F.col("llm_answer")),
            P.RECALL_SYSTEM, lambda r: {"recall_score": J.recall_score(r)}, lambda r: closed_book_failed(r.recall_score),
        )
        done = F.struct(
            F.lit(number).alias("round"), "new_identifier", "relation", F.col("_new_question").alias("question")
        ).cast(_ROUND)
        return rows.withColumns({"_rounds": F.concat("_rounds", F.array(done)), "_subject": F.col("new_identifier")}).drop(
            "new_identifier", "relation", "_new_question"
        )

    def __call__(self, df: DataFrame) -> DataFrame:
        rows = fill_identifiers(df.filter(~is_blank(F.col("question"))), self.generator)
        rows = rows.withColumns(
            {"_rounds": F.array().cast(f"array<{_ROUND}>"), "_subject": F.col("identifier")}
        )
        for number in range(1, self.n_rounds + 1):
            rows = self._round(rows, number)
        kept = [c for c in rows.columns if c not in ("_rounds", "_subject")]
        each = rows.select(*kept, F.explode(entries("_rounds")).alias("_d"))
        order = {"rec_ord": F.concat("rec_ord", F.array("_d.round"))} if "rec_ord" in kept else {}
        return each.withColumns(
            {
                **order,
                "question": F.col("_d.question"),
                "answer": F.coalesce("identifier", F.lit("")),
                "depth_round": F.col("_d.round"),
                "new_identifier": F.col("_d.new_identifier"),
                "relation": F.col("_d.relation"),
                "qa_type": F.lit("depth"),
                "hop_type": F.lit("singlehop"),
            }
        ).drop("_d")


def adjacent_pairs(indexed: DataFrame, columns: Sequence[str], idx: str = "idx") -> DataFrame:
    """Rows ``i`` and ``i + 1`` side by side: ``merge_index, left, right``.

    An equi join on the dense index, so no window runs over the whole table.
    """
    side = F.struct(idx, *columns)
    left = indexed.select(F.col(idx).alias("merge_index"), side.alias("left"))
    right = indexed.select((F.col(idx) - 1).alias("merge_index"), side.alias("right"))
    return left.join(right, "merge_index")


def gather(links: DataFrame, indexed: DataFrame, columns: Sequence[str], idx: str = "idx") -> DataFrame:
    """Follow lists of row numbers back to the rows: adds ``wanted`` and ``sources`` to ``links``.

    ``links`` holds one row per ``merge_index`` with a list ``indices``; the lists come from single
    responses, so the regrouped lists are as short as those. ``sources`` keeps list order and leaves
    unknown numbers out. The other columns ride along, so ``links`` is computed once.
    """
    carried = [c for c in links.columns if c != "merge_index"]
    each = links.select("*", F.posexplode_outer("indices").alias("_at", idx))
    rows = indexed.select(F.col(idx).cast("bigint").alias(idx), F.struct(*columns).alias("row"))
    found = each.join(rows, idx, "left")
    gathered = found.groupBy("merge_index").agg(
        *[F.first(c).alias(c) for c in carried],
        F.count("_at").alias("wanted"),
        F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("_at", "row")))).alias("_found"),
    )
    return gathered.withColumn("sources", F.transform("_found", lambda s: s.row)).drop("_found")


def _first_object(response: Column) -> Column:
    """The response as an object: itself, or the first element of a list."""

    def first(v: Column) -> Column:
        return F.when(J.is_array(v), F.get(J.items(v), 0)).otherwise(v)

    parsed = let(J.strict_json(J.clean_json_block(response)), first)
    return let(parsed, lambda v: F.when(J.is_object(v), v))


def _merge_fields(v: Column) -> dict[str, Column]:
    at = J.member(v, "index")
    listed = F.when(J.is_array(at), J.items(at)).otherwise(F.array(at))
    return {
        "question": J.as_text(J.member(v, "question")),
        "content_identifier": F.coalesce(J.as_text(J.member(v, "content_identifier")), F.lit("")),
        "indices": F.when(at.isNotNull(), F.transform(listed, lambda x: J.whole_number(x).cast("bigint"))),
    }


def _is_one(v: Column) -> Column:
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce((F.schema_of_variant(v) != "STRING") & (number == 1), F.lit(False))


@dataclass(frozen=True)
class WidthQA:
    """Merges neighbouring questions, checks that the merge can be taken apart and is not common knowledge.

    A merged question whose list names an unknown row is dropped; ``resolved`` shows them all.
    """

    generator: Generator
    order: tuple[str, ...] = ("source_md", "chunk_index", "rec_ord")

    def indexed(self, df: DataFrame) -> DataFrame:
        rows = fill_identifiers(df.filter(~is_blank(F.col("question"))), self.generator)
        return dense_index(rows, list(self.order))

    def resolved(self, indexed: DataFrame) -> DataFrame:
        """All readable merges with their source rows and a ``complete`` flag."""

        def item(side: str) -> Column:
            at = F.col(side)
            return F.struct(
                at.idx.alias("index"), at.question.alias("question"), at.identifier.alias("content_identifier"),
                at.answer.alias("golden_answer"),
            )

        pairs = adjacent_pairs(indexed, ["question", "identifier", "answer"])
        items = F.to_json(F.array(item("left"), item("right")))
        merged = ask_and_read(
            self.generator, pairs, "width_merge", P.WIDTH_MERGE.render(items=items), P.WIDTH_MERGE_SYSTEM, _merge_fields,
            lambda r: r.question.isNotNull() & r.indices.isNotNull(), _first_object,
        ).drop("left", "right")
        found = gather(merged, indexed, [c for c in indexed.columns if c != "idx"])
        return found.withColumn("complete", F.col("wanted") == F.size("sources"))

    def __call__(self, df: DataFrame) -> DataFrame:
        indexed = self.indexed(df)
        rows = self.resolved(indexed).filter("complete").drop("wanted", "complete")
        rows = rows.withColumns(
            {
                "original_question": F.transform("sources", lambda s: s.question),
                "original_answer": F.transform("sources", lambda s: s.answer),
            }
        )
        check = F.to_json(
            F.struct(
                F.col("merge_index").alias("index"),
                F.col("question").alias("complex_question"),
                F.col("original_question").alias("original_questions"),
            )
        )
        rows = ask_and_read(
            self.generator, rows, "width_origin", P.WIDTH_ORIGIN.render(item=check), P.WIDTH_ORIGIN_SYSTEM,
            lambda v: {"_one": _is_one(J.member(v, "state")), "_task": J.filled_text_of(v, "complex_question")},
            lambda r: r["_one"], _first_object,
        ).withColumn("question", first_filled(F.col("_task"), F.col("question"))).drop("_one", "_task")
        asked = F.to_json(F.struct(F.col("merge_index").alias("index"), F.col("question").alias("complex_question")))
        rows = ask_and_read(
            self.generator, rows, "width_answer", P.WIDTH_ANSWER.render(item=asked), P.WIDTH_ANSWER_SYSTEM,
            lambda v: {"llm_answer": F.when(~F.is_variant_null(J.member(v, "llm_answer")), J.as_text(J.member(v, "llm_answer")))},
            lambda r: r.llm_answer.isNotNull(), _first_object,
        )
        answers = F.filter(F.transform("original_answer", lambda a: py_strip(F.coalesce(a, F.lit("")))), lambda a: a != "")
        rows = rows.withColumn("answer", F.array_join(answers, ANSWER_JOINT))
        rows = ask_and_read(
            self.generator, rows, "width_recall", P.RECALL.render(golden=F.col("answer"), other=F.col("llm_answer")),
            P.RECALL_SYSTEM, lambda r: {"recall_score": J.recall_score(r)}, lambda r: closed_book_failed(r.recall_score),
        ).drop("recall_score", "llm_answer")
        own = {"question", "answer", "qa_type", "hop_type", "content_identifier", "original_question", "original_answer"}
        first = F.get("sources", F.lit(0))
        copied = [first[c].alias(c) for c in indexed.columns if c not in own | {"idx"}]
        return rows.select(
            *copied,
            "question",
            "answer",
            F.lit("width").alias("qa_type"),
            F.lit("singlehop").alias("hop_type"),
            "content_identifier",
            F.col("indices").alias("source_question_indices"),
            "original_question",
            "original_answer",
            F.col("sources").alias("source_rows"),
        )

"""Multi-hop question generation from sentence contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions import jsontext as J
from qaspark.functions.text import complexity, let, py_lower_strip, py_strip, strip_bound
from qaspark.operators import prompts as P
from qaspark.operators.base import LimitPerChunk, entries, first_per_group, fold_in_blocks, require
from qaspark.operators.contexts import context_language
from qaspark.operators.generation import Generator
from qaspark.operators.language import normalize_language

# What a strictly valid object must have, beside filled texts. No member can then be absent.
MIN_STEPS = 2
MIN_FACTS = 2
# What is read of an object, in the forms that most responses have.
PAIR = "struct<question:string,reasoning_steps:array<struct<step:string>>,answer:string,supporting_facts:array<string>,type:string>"
# Up to this size a list of pairs is compared without sorting.
FEW = 32


def reasoning_steps(value: Column) -> Column:
    """``array<struct<step>>`` from step objects or plain texts; blank steps and non-lists give nothing."""
    steps = F.transform(
        J.items(value),
        lambda x: F.struct(
            F.when(J.is_object(x), J.text_of(x, "step")).otherwise(py_strip(J.as_text(x))).alias("step")
        ),
    )
    return F.filter(steps, lambda s: s.step != "")


def _normal(x: Column) -> Column:
    """The fields of an object, all read in one cast. Only what the cast cannot tell is looked up by its name."""

    def fields(r: Column) -> Column:
        def text(key: str) -> Column:
            return F.when(J.is_told(r[key]), strip_bound(r[key])).otherwise(J.text_of(x, key))

        steps = F.filter(F.transform(r.reasoning_steps, lambda s: F.struct(strip_bound(s.step).alias("step"))), lambda s: s.step != "")
        facts = F.filter(F.transform(r.supporting_facts, strip_bound), lambda t: t != "")
        steps_told = F.forall(r.reasoning_steps, lambda s: J.is_told(s.step))
        facts_told = F.forall(r.supporting_facts, J.is_told)
        return F.struct(
            text("question").alias("question"),
            F.when(steps_told, steps).otherwise(reasoning_steps(J.member(x, "reasoning_steps"))).alias("reasoning_steps"),
            text("answer").alias("answer"),
            F.when(facts_told, facts).otherwise(J.text_items(J.member(x, "supporting_facts"))).alias("supporting_facts"),
            text("type").alias("type"),
        )

    return let(F.try_variant_get(x, "$", PAIR), fields)


def _is_valid(qa: Column, strict: bool) -> Column:
    filled = (qa.question != "") & (qa.answer != "")
    if not strict:
        return filled
    return (
        filled
        & (qa.type != "")
        & (F.size(qa.reasoning_steps) >= MIN_STEPS)
        & (F.size(qa.supporting_facts) >= MIN_FACTS)
    )


def valid_pairs(objects: Column, strict: bool) -> Column:
    """Normalised valid pairs of an ``array<variant>`` of objects."""
    return F.filter(F.transform(objects, _normal), lambda qa: _is_valid(qa, strict))


def first_by_question(pairs: Column) -> Column:
    """First pair of every lower-cased question, in order, inside one response: sorted by question and place, then by place.

    Most responses have one pair, and nothing to compare; the first place of a question in a few is found without sorting.
    """
    keyed = F.transform(pairs, lambda p, i: F.struct(py_lower_strip(p.question).alias("k"), i.alias("i"), p.alias("p")))
    firsts = let(
        F.array_sort(keyed),
        lambda ks: F.filter(ks, lambda x, j: (j == 0) | (F.get(ks, j - 1).k != x.k)),
    )
    placed = F.array_sort(F.transform(firsts, lambda x: F.struct(x.i.alias("i"), x.p.alias("p"))))
    few = let(
        F.transform(pairs, lambda p: py_lower_strip(p.question)),
        lambda ks: F.filter(pairs, lambda p, i: F.array_position(ks, F.get(ks, i)) == i + 1),
    )
    return F.when(F.size(pairs) <= 1, pairs).when(F.size(pairs) <= FEW, few).otherwise(F.transform(placed, lambda x: x.p))


def braced_objects(response: Column) -> Column:
    """Top-level brace groups of a text, by counting braces only.

    A stray closing brace makes the count negative, after which later groups are not seen; braces in
    quoted text count as well. A fold over the pieces between closing braces, inside the JVM: of a piece only
    the number of its opening braces matters.
    """
    start = F.struct(
        F.array().cast("array<struct<i:int,nth:int,last:int>>").alias("done"),
        F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("nth"),
    )

    def step(acc: Column, opens: Column) -> Column:
        depth = acc.depth + opens
        begins = (acc.depth <= 0) & (depth > 0)
        i, nth = F.when(begins, acc.at).otherwise(acc.i), F.when(begins, 1 - acc.depth).otherwise(acc.nth)
        group = F.struct(i.alias("i"), nth.alias("nth"), acc.at.alias("last"))
        return F.struct(
            F.when(depth == 1, F.concat(acc.done, F.array(group))).otherwise(acc.done).alias("done"),
            (depth - 1).alias("depth"),
            (acc.at + 1).alias("at"),
            i.alias("i"),
            nth.alias("nth"),
        )

    def groups(pieces: Column, opens: Column) -> Column:
        # the fold finds ranges of pieces and the brace of the first one that opens, the texts are joined once
        def joined(g: Column) -> Column:
            head = F.call_function("substring_index", F.get(pieces, g.i - 1), F.lit("{"), g.nth - 1 - F.get(opens, g.i - 1))
            more = F.concat(F.lit("}"), F.array_join(F.slice(pieces, g.i + 1, g.last - g.i), "}"))
            return F.concat(F.lit("{"), head, F.when(g.last > g.i, more).otherwise(F.lit("")), F.lit("}"))

        closed = F.slice(opens, 1, F.size(opens) - 1)
        return F.transform(fold_in_blocks(closed, start, step).done, joined)

    # what lies between closing braces, once with and once without the text
    opens = F.transform(F.split(F.regexp_replace(response, r"[^{}]+", ""), r"\}"), F.octet_length)
    return let(F.split(response, r"\}"), lambda pieces: let(opens, lambda n: groups(pieces, n)))


def with_multihop_pairs(df: DataFrame, strict: bool = True, to: str = "pairs") -> DataFrame:
    """Add the valid pairs of ``response``: the whole text as JSON first, else its brace groups."""
    whole = df.withColumn("_v", J.strict_json(F.col("response")))
    listed = F.when(J.is_object(F.col("_v")), F.array("_v")).otherwise(J.items(F.col("_v")))
    direct = whole.withColumn("_direct", valid_pairs(listed, strict))
    # the brace scan runs only for rows whose whole text gave nothing
    found = F.when(F.size("_direct") > 0, F.col("_direct")).otherwise(_scanned_pairs(F.col("response"), F.col("_v"), strict))
    return direct.withColumn("_found", found).withColumn(to, first_by_question(F.col("_found"))).drop(
        "_v", "_direct", "_found"
    )


def _scanned_pairs(response: Column, v: Column, strict: bool) -> Column:
    """Valid pairs of the brace groups. Groups that cannot give one are not parsed: those that name no question
    (in plain letters or by escapes), and the whole text where it is an object that gave none.
    """
    refused = F.when(J.is_object(v), F.btrim(response, F.lit(J.JSON_SPACES)))

    def named(groups: Column, known: Column) -> Column:
        return F.filter(groups, lambda g: (F.contains(g, F.lit("question")) | F.contains(g, F.lit("\\"))) & ~g.eqNullSafe(known))

    groups = let(refused, lambda known: named(braced_objects(response), known))
    scanned = F.filter(F.transform(groups, J.strict_json), J.is_object)
    return valid_pairs(scanned, strict)


@dataclass(frozen=True)
class FirstByQuestion:
    """First row of every question inside its group, compared in lower case; blank questions are dropped.

    ``keys`` is the chunk by default; an empty list compares over the whole table. One row per question
    survives in each input partition before the shuffle, so many copies of one question do no harm.
    """

    keys: tuple[str, ...] = ("source_md", "chunk_index")
    order: tuple[str, ...] = ("rec_ord",)

    def __call__(self, df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_norm", py_lower_strip(F.col("question"))).filter(F.col("_norm") != "")
        return first_per_group(keyed, [*self.keys, "_norm"], list(self.order), 1).drop("_norm")


@dataclass(frozen=True)
class MultiHopQA:
    """Pairs of each context; per chunk the first ``num_q`` different questions are kept."""

    generator: Generator
    target_language: str = "zh"
    system_prompt: str | None = None
    num_q: int = 5
    strict_validation: bool = True

    def __post_init__(self) -> None:
        require(self.num_q > 0, "num_q must be positive")
        normalize_language(self.target_language)

    def __call__(self, df: DataFrame) -> DataFrame:
        language = context_language(normalize_language(self.target_language))
        bare = self.generator.ask_bare(
            df,
            "multihop",
            P.MULTIHOP[language].render(context=F.col("context")),
            P.multihop_system(language, self.system_prompt),
            lambda answered: with_multihop_pairs(answered, self.strict_validation, "_pairs"),
        )
        asked = bare.rows
        columns = [c for c in df.columns if c in asked.columns and c != "rec_ord"]
        place = F.array("info_pair_index", "_j").alias("rec_ord")
        told = [
            F.col("_p.question").alias("question"),
            F.col("_p.answer").alias("answer"),
            F.lit("multihop").alias("hop_type"),
            F.col("_p.reasoning_steps").alias("reasoning_steps"),
            F.col("_p.supporting_facts").alias("supporting_facts"),
            F.col("_p.type").alias("qa_type"),
        ]
        firsts, limit = FirstByQuestion(), LimitPerChunk(self.num_q)
        if bare.again is None:
            each = asked.select(*columns, F.posexplode(entries("_pairs")).alias("_j", "_p"))
            kept = limit(firsts(each.select(*columns, place, *told)))
        else:
            # the question alone decides; the rest is read again at the places of the rows that are kept
            asks = F.array_compact(F.transform("_pairs", lambda p: p.question))
            each = asked.select(*columns, *bare.carried, F.posexplode(asks).alias("_j", "question"))
            some = bare.again(limit(firsts(each.select(*columns, *bare.carried, place, "question")).drop("question")))
            kept = some.withColumn("_p", F.get("_pairs", F.get("rec_ord", F.lit(1)))).select(*columns, "rec_ord", *told)
        # texts come back to the rows that are kept, where the columns of the contexts come first as before
        first = [c for c in df.columns if c != "rec_ord"]
        rest = [c for c in kept.columns if c not in first]
        return bare.attach(kept).select(*first, *rest).withColumn(
            "complexity",
            complexity(F.col("reasoning_steps"), F.col("supporting_facts"), F.col("question"), F.col("answer")),
        )

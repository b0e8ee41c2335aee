"""A deterministic stand-in for a model: each stage's response is an expression of the stage's inputs.

Responses come in the forms a model really gives (bare JSON, fenced JSON, JSON after chatter, plain
lines, unusable text); which form a row gets follows from text lengths. The expected results are
written independently in the SQL of the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from qaspark.operators.generation import ExpressionGenerator
from qaspark.schemas import DIMENSIONS

L = F.length
C = F.col


def _case(selector: Column, *answers: Column | str) -> Column:
    out = None
    for i, a in enumerate(answers):
        value = F.lit(a) if isinstance(a, str) else a
        out = F.when(selector == i, value) if out is None else out.when(selector == i, value)
    return out


def _obj(**fields: Column | str) -> Column:
    return F.to_json(
        F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]),
        {"ignoreNullFields": "false"},
    )


def _list(*objects: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *objects), F.lit("]"))


def _fence(c: Column) -> Column:
    return F.concat(F.lit("```json\n"), c, F.lit("\n```"))


def score_rule(k: int) -> Column:
    grade = (L("question") * (k + 1) + L("answer") + L("chunk_text")) % 5 + 1
    shown = F.when(grade == 3, F.lit("3.5")).otherwise(grade.cast("string"))
    full = F.concat(F.lit("**Grading**: "), shown, F.lit("\n**Feedback**:  seen "), L("answer").cast("string"), F.lit("\nend "))
    return F.when((L("question") + k) % 7 == 0, F.lit("no grade")).otherwise(full)


def _steps(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.alias("step")), F.struct(b.alias("step")))


def _hop(question: Column, p: Column, i: Column, c: Column, kind: str = "chain") -> Column:
    return _obj(question=question, reasoning_steps=_steps(p, i), answer=c, supporting_facts=F.array(p, i), type=kind)


def _merged(question: Column, index: Column) -> Column:
    head = F.regexp_replace(_obj(question=question, content_identifier=C("right.identifier")), r"\}\z", "")
    return F.concat(head, F.lit(', "index": '), index, F.lit("}"))


def _tag(level1: str, level2: Column | str, task: str, style: str) -> Column:
    return _obj(level1_name=level1, level2_name=level2, task_type=task, reasoning_style=style)


def singlehop_rules() -> dict[str, Column]:
    n = L("chunk_text")
    instructions = _case(
        n % 5,
        '["Ask who acts","Ask what follows"]',
        '```json\n["Ask who acts", "  ", "Ask when"]\n```',
        '[Ask where, "Ask why"]',
        "no list here",
        '{"a": 1}',
    )
    _q = F.concat("generated_prompt", F.lit(" in "), n, F.lit(" characters?"))
    _a = F.md5("chunk_text")
    pairs = _case(
        (n + L("generated_prompt")) % 4,
        F.concat(
            F.lit('{"qa_pairs": '),
            _list(_obj(question=_q, answer=_a), _obj(input=F.concat(_q, F.lit(" More?")), output=F.concat(_a, F.lit(" more")))),
            F.lit("}"),
        ),
        F.concat(F.lit("Note first\nQ: old\nq:  "), _q, F.lit(" \nA: "), _a, F.lit("\n")),
        F.concat(
            F.lit('Result: {"qa_pairs": '),
            _list(_obj(instruction=_q, answer=_a), _obj(question="", answer="x"), F.lit("7")),
            F.lit("}"),
        ),
        "",
    )
    return {"instructions": instructions, "pairs": pairs}


def edit_rules() -> dict[str, Column]:
    _expanded = {"expanded_question": F.concat(F.lit("More: "), "question"), "expanded_answer": F.concat("answer", F.lit(" [grounded]"))}
    expand = _case(
        (L("question") + L("answer")) % 5,
        _obj(**_expanded, expansion_type="contextual", expansion_notes=" kept "),
        _fence(_obj(**_expanded)),
        "sorry",
        '{"expanded_question": ""}',
        "{broken",
    )
    think = _case(
        (L("question") + 2 * L("answer")) % 4,
        _obj(think=" because ", answer=F.concat(F.lit("New: "), "answer")),
        '{"think": "", "answer": ""}',
        F.concat(F.lit("x "), _obj(think=F.lit(None).cast("string"), answer=C("question"))),
        "",
    )
    return {"expand": expand, "think": think}


def multihop_rules() -> dict[str, Column]:
    _clean = {c: F.translate(c, "{}", "") for c in ("premise", "intermediate", "conclusion")}
    _hop_q = F.concat(F.lit("How do "), L("premise"), F.lit(" and "), L("intermediate"), F.lit(" meet?"))
    multihop = _case(
        L("context") % 5,
        _hop(_hop_q, C("premise"), C("intermediate"), C("conclusion")),
        _list(
            _hop(_hop_q, C("premise"), C("intermediate"), C("conclusion")),
            _hop(F.upper(_hop_q), C("premise"), C("intermediate"), C("conclusion")),
            _hop(F.lit("No type?"), C("premise"), C("intermediate"), C("conclusion"), ""),
        ),
        F.concat(
            F.lit("Sure! "),
            _hop(_hop_q, _clean["premise"], _clean["intermediate"], _clean["conclusion"]),
            F.lit(" and "),
            _hop(F.lit("Second?"), _clean["intermediate"], _clean["premise"], _clean["conclusion"], "pair"),
            F.lit(" } "),
            _hop(F.lit("Lost?"), _clean["intermediate"], _clean["premise"], _clean["conclusion"]),
        ),
        _obj(
            question=_hop_q, reasoning_steps=F.array(F.struct(C("premise").alias("step"))), answer=C("conclusion"),
            supporting_facts=F.array("premise", "intermediate"), type="short",
        ),
        _obj(
            question=_hop_q, reasoning_steps=F.array("premise", F.lit(" "), "intermediate"), answer=C("conclusion"),
            supporting_facts=F.array("premise", F.lit(""), "intermediate", F.lit("third")), type="plain",
        ),
    )
    return {"multihop": multihop}


def atomic_rules() -> dict[str, Column]:
    n = L("chunk_text")
    atomic = {
        "identifier": _case(
            n % 3,
            _obj(content_identifier=F.concat(F.lit("id-"), n)),
            F.concat(F.lit("  subject "), n, F.lit(" ")),
            '```json {"content_identifier": ""}```',
        ),
        "conclusions": _case(
            n % 4,
            _list(
                _obj(conclusion=F.concat(F.lit("fact one of "), n), R="size"),
                _obj(conclusion="", R="x"),
                _obj(conclusion="fact beyond the cut", R="measure"),
            ),
            _obj(conclusion=F.concat(F.lit(" lone fact "), n), R="lone"),
            "none",
            _fence(_list(F.lit("1"), _obj(conclusion=F.concat(F.lit("the fact after "), n), R="order"))),
        ),
        "atomic_question": F.when(L(C("_task.conclusion")) % 5 == 0, F.lit('{"Q": ""}')).otherwise(
            _obj(Q=F.concat(F.lit("Which value is "), C("_task.conclusion"), F.lit("?")))
        ),
        "refine": F.when(L("question") % 7 == 0, F.lit("none")).otherwise(_obj(refined_answer=F.upper("answer"))),
        "closed_book": F.concat(F.lit("guess "), L("question")),
        "closed_recall": _case(
            (L("question") + n) % 4, '{"answer_score": 0}', '{"answer_score": "0"}', '{"answer_score": 1}', "bad"
        ),
        "open_book": F.concat("refined_answer", F.lit(", and more!")),
        "open_recall": _case(n % 3, '{"answer_score": 2}', '{"answer_score": 1.9}', '{"answer_score": 0}'),
        "alternatives": _case(
            n % 2,
            F.to_json(F.array("refined_answer", F.concat(F.lit("The "), F.lower("refined_answer")), F.lit(" "))),
            "none",
        ),
    }
    return atomic


def taxonomy_rules() -> dict[str, Column]:
    n = L("chunk_text")
    _size = F.when(n < 1000, F.lit("Short")).otherwise(F.lit("Long"))
    taxonomy = {
        "tags": _case(
            n % 4,
            F.concat(F.lit('{"tags": '), _list(_tag("Form", _size, "fact", "direct"), _tag("Content", "Facts", "compare", "chain")), F.lit("}")),
            F.concat(F.lit('{"tags": '), _list(_tag("Form", "Unknown", "fact", "direct"), _tag("Content", "Order", "fact ", "direct")), F.lit("}")),
            "not json",
            F.concat(F.lit('x {"tags": '), _list(_tag("Content", "Facts", "unknown", "direct"), F.lit("5"), _tag("Form", "", "fact", "direct")), F.lit("}")),
        ),
        "taxonomy_question": F.when((L("level2_name") + n) % 3 == 0, F.lit('{"question": null}')).otherwise(
            _obj(question=F.concat(F.lit("What about "), "level2_name", F.lit(" in "), n, F.lit("?")))
        ),
        "taxonomy_answer": F.when(L("question") % 4 == 0, F.lit("")).otherwise(_obj(answer=F.concat(F.lit(" Answer "), F.md5("chunk_text")))),
    }
    return taxonomy


def depth_rules() -> dict[str, Column]:
    depth = {
        "identifier": _obj(content_identifier=F.concat(F.lit("subject "), L("answer"))),
        "superset": F.when(L("_subject") % 6 == 0, F.lit('{"identifier": "x"}')).otherwise(
            _obj(identifier=F.concat("_subject", F.lit("+")), relation="part of")
        ),
        "superset_check": F.when((L("question") + L("new_identifier")) % 5 == 0, F.lit('{"new_query": "invalid"}')).otherwise(
            F.lit('{"new_query": "valid"}')
        ),
        "depth_question": F.when((L("answer") + L("new_identifier")) % 7 == 0, F.lit('{"new_query": ""}')).otherwise(
            _obj(new_query=F.concat(F.lit("What is part of "), "new_identifier", F.lit("?")))
        ),
        "depth_answer": F.concat(F.lit("no idea "), L("question")),
        "depth_recall": F.when((L("question") + L("answer") + L("new_identifier")) % 4 == 3, F.lit('{"answer_score": 1}')).otherwise(
            F.lit('{"answer_score": 0}')
        ),
    }
    return depth


def width_rules() -> dict[str, Column]:
    _left, _right = C("left.idx").cast("string"), C("right.idx").cast("string")
    _merged_q = F.concat(C("left.question"), F.lit(" / "), C("right.question"))
    width = {
        "identifier": depth_rules()["identifier"],
        "width_merge": F.when(
            L(C("left.question")) % 13 == 5, _list(_merged(_merged_q, F.concat(F.lit("["), _left, F.lit(", 99999999]"))))
        ).otherwise(
            _case(
                L(C("left.question")) % 4,
                _list(_merged(_merged_q, F.concat(F.lit("["), _left, F.lit(", "), _right, F.lit("]")))),
                _merged(_merged_q, F.concat(F.lit('["'), _right, F.lit('", '), _left, F.lit("]"))),
                "bad",
                _merged(_merged_q, _left),
            )
        ),
        "width_origin": F.when(L("question") % 3 == 0, F.lit('[{"state": 0}]')).otherwise(
            F.when(
                L("question") % 3 == 1,
                _list(_obj(index=C("merge_index"), complex_question=F.concat(F.lit("Both: "), "question"), state=F.lit(1))),
            ).otherwise(F.lit('{"state": 1.0, "complex_question": ""}'))
        ),
        "width_answer": F.when(L("question") % 5 == 4, F.lit('[{"llm_answer": null}]')).otherwise(F.lit('[{"llm_answer": "unknown"}]')),
        "width_recall": F.when(L("answer") % 3 == 2, F.lit('{"answer_score": 2}')).otherwise(F.lit('{"answer_score": 0}')),
    }
    return width


def score_rules() -> dict[str, Column]:
    return {dimension: score_rule(k) for k, dimension in enumerate(DIMENSIONS)}


FLOWS = {
    "singlehop": singlehop_rules,
    "atomic": atomic_rules,
    "taxonomy": taxonomy_rules,
    "multihop": multihop_rules,
    "depth": depth_rules,
    "width": width_rules,
    "scores": score_rules,
    "edits": edit_rules,
}


def model(*flows: str) -> ExpressionGenerator:
    """The stand-in for the stages of the named flows."""
    return ExpressionGenerator({stage: rule for flow in flows for stage, rule in FLOWS[flow]().items()})

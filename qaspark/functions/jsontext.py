"""Reading model responses: strict JSON inside free text, as Column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from qaspark.functions.text import WS, let, py_strip, strip_bound


# Fixed value: what JSON itself allows around a value.
JSON_SPACES = " \t\n\r"
# Fixed value: first characters of JSON values.
JSON_BEGINS = '{["-0123456789tfn'


def _without_fence(text: Column, *openings: str) -> Column:
    """A stripped text without the first of ``openings`` that it starts with and without one closing fence.

    By prefix and suffix: a pattern is tried at every character of a response.
    """
    bare = text
    for mark in reversed(openings):
        bare = F.when(text.startswith(mark), F.substr(text, F.lit(len(mark) + 1))).otherwise(bare)
    return let(bare, lambda b: py_strip(F.when(b.endswith("```"), F.left(b, F.length(b) - 3)).otherwise(b)))


def clean_json_block(c: Column) -> Column:
    """Trim, drop one opening code fence (json fence, then plain) and one closing fence, trim."""

    def unfence(text: Column) -> Column:
        bare = _without_fence(text, "```json```", "```json", "```")
        return F.when(text.startswith("```") | text.endswith("```"), bare).otherwise(text)

    return let(py_strip(c), unfence)


def json_object_tail(c: Column) -> Column:
    """From the first ``{`` of the unfenced response to its end; null when there is none."""

    def unfence(text: Column) -> Column:
        return F.when(text.startswith("```"), _without_fence(text, "```json", "```")).otherwise(text)

    def tail(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("{")), F.substr(text, F.locate("{", text)))

    return let(py_strip(c), lambda text: let(unfence(text), tail))


def strict_json(c: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null.

    The parser itself stops at the end of the first value. So the text is parsed as the only member of
    an object, which settles its grammar, and counted as the elements of an array: a text that closes
    its surroundings early or brings a second value gives another count than one. Chatter is told by its first character.
    """

    def parse(text: Column) -> Column:
        begins = F.left(F.ltrim(text, F.lit(JSON_SPACES)), F.lit(1)).isin(*JSON_BEGINS)
        alone = begins & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1)
        as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
        return F.when(alone, F.try_variant_get(as_member, "$.v", "variant"))

    return let(c, parse)


def is_object(v: Column) -> Column:
    # a struct without fields can be had from any object and from nothing else; the schema would be built from all members
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def json_object(c: Column) -> Column:
    """VARIANT object of a fenced or bare response, else null."""
    return let(strict_json(clean_json_block(c)), lambda v: F.when(is_object(v), v))


def json_tail_object(c: Column) -> Column:
    """VARIANT object that starts at the first brace of the response, else null."""
    return let(strict_json(json_object_tail(c)), lambda v: F.when(is_object(v), v))


def items(v: Column) -> Column:
    """Elements of a VARIANT array as ``array<variant>``; anything else gives an empty array."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.from_json(F.lit("[]"), "array<variant>"))


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def as_text(v: Column) -> Column:
    """Text of any JSON value; null stays the word None and booleans are capitalised."""

    return let(v, lambda x: let(F.try_variant_get(x, "$", "string"), lambda plain: _shown(plain, x)))


def _shown(plain: Column, v: Column) -> Column:
    """``as_text`` of ``v``, whose plain text is known: only null, true and false need another look at the value."""
    boolean = plain.isin("true", "false") & (F.schema_of_variant(v) == "BOOLEAN")
    return F.when(plain.isNull() & F.is_variant_null(v), F.lit("None")).when(boolean, F.initcap(plain)).otherwise(plain)


def is_told(plain: Column) -> Column:
    """Whether a value's plain text is its ``as_text``: absent and null look alike, and so do booleans and the same words as text."""
    return F.coalesce(~plain.isin("true", "false"), F.lit(False))


def text_of(v: Column, key: str) -> Column:
    """Stripped text of a member; a missing member is empty, an explicit null is the word None."""
    plain = F.try_variant_get(v, f"$.{key}", "string")
    return let(F.coalesce(let(plain, lambda p: _shown(p, member(v, key))), F.lit("")), strip_bound)


def _filled_text(v: Column) -> Column:
    """Text of a JSON value, null where the value is absent, null, false, zero or empty."""

    def text(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        plain = F.try_variant_get(x, "$", "string")
        empty = (
            (kind == "VOID")
            | ((kind == "STRING") & (plain == ""))
            | ((kind == "BOOLEAN") & (plain == "false"))
            | ((kind != "STRING") & plain.isin("[]", "{}"))
            | ((kind != "STRING") & (plain.try_cast("double") == 0))
        )
        shown = F.when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)
        return F.when(~F.coalesce(empty, F.lit(False)), shown)

    return let(v, text)


def filled_text_of(v: Column, *keys: str) -> Column:
    """Stripped text of the first member that is not null, false, zero or empty; else empty."""
    return py_strip(F.coalesce(*[_filled_text(member(v, key)) for key in keys], F.lit("")))


def text_items(v: Column) -> Column:
    """Non-blank stripped texts of a JSON list, in order."""
    return F.filter(F.transform(items(v), lambda x: py_strip(as_text(x))), lambda t: t != "")


def content_identifier(response: Column) -> Column:
    """``content_identifier`` of a JSON response, or the whole cleaned response."""
    named = _filled_text(member(json_object(response), "content_identifier"))
    return F.coalesce(py_strip(named), clean_json_block(response))


def whole_number(v: Column) -> Column:
    """Integer of a JSON number (truncated), boolean or integer text; null otherwise."""

    def number(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        text = py_strip(F.try_variant_get(x, "$", "string"))
        digits = F.when(text.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(text, F.lit("_"), F.lit("")))
        return (
            F.when(kind == "BOOLEAN", F.when(text == "true", F.lit(1)).otherwise(F.lit(0)))
            .when(kind == "STRING", digits.try_cast("int"))
            .otherwise(text.try_cast("double").try_cast("int"))
        )

    return let(v, number)


def recall_score(response: Column) -> Column:
    return whole_number(member(json_object(response), "answer_score"))


def grade(response: Column) -> Column:
    """First number after the grading mark, 0 when there is none; not clamped."""
    digits = F.regexp_extract(response, rf"\*\*Grading\*\*:[{WS}]*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def feedback(response: Column) -> Column:
    return py_strip(F.regexp_extract(response, rf"(?s)\*\*Feedback\*\*:[{WS}]*(.+)", 1))

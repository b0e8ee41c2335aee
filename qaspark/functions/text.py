"""Text functions as Column expressions.

Whitespace follows Unicode ``White_Space`` plus the four information separators, which is wider
than Spark's ``trim`` (space only) and Java's ``\\s`` (ASCII only).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The 29 code points that count as whitespace.
SPACE_CODEPOINTS = (
    list(range(0x09, 0x0E))
    + list(range(0x1C, 0x21))
    + [0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
SPACES = "".join(chr(c) for c in SPACE_CODEPOINTS)
# The same set as the inside of a Java character class. The wide part sits behind an intersection, so
# an ASCII character is decided by one table lookup; a flat class is three times slower on plain text.
_WIDE_SPACES = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = rf"\x{{9}}-\x{{D}}\x{{1C}}-\x{{20}}[\x{{85}}-\x{{3000}}&&[{_WIDE_SPACES}]]"

# Ideograph blocks that never count as special characters.
IDEOGRAPHS = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"
    r"\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
)
# Letters, numbers, whitespace and ideographs, with ASCII split off for the same reason.
_PLAIN = (
    r"a-zA-Z0-9\x{9}-\x{D}\x{1C}-\x{20}"
    rf"[\x{{80}}-\x{{10FFFF}}&&[\p{{L}}\p{{N}}{_WIDE_SPACES}{IDEOGRAPHS}]]"
)
# ASCII punctuation removed before answers are compared.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a variable, so that a costly expression is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_bound(v: Column) -> Column:
    """``py_strip`` of a value that costs nothing to read (a column or a lambda variable).

    Trimming walks over the whole text, and most texts have nothing to trim: their first and last bytes are visible ASCII.
    """
    last = F.substr(v.cast("binary"), F.lit(-1), F.lit(1))
    bare = (v >= "!") & (v < "\x7f") & (last >= F.lit(b"!")) & (last < F.lit(b"\x7f"))
    return F.when(bare, v).otherwise(py_strip(v))


def py_lower_strip(c: Column) -> Column:
    return F.lower(py_strip(c))


def py_words(c: Column) -> Column:
    """Words between whitespace runs; blank text gives an empty array."""
    return F.array_remove(F.split(c, f"[{WS}]+"), "")


def word_count(c: Column) -> Column:
    return F.size(py_words(c))


def is_blank(c: Column) -> Column:
    return py_strip(F.coalesce(c, F.lit(""))) == ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string, else the last argument."""
    *heads, last = cols
    return F.coalesce(*[blank_to_null(c) for c in heads], last)


def special_char_ratio(c: Column) -> Column:
    """Share of characters that are no letter, number, whitespace or ideograph; 0 for empty text."""
    special = F.length(F.regexp_replace(c, f"[{_PLAIN}]+", ""))
    return F.when(F.length(c) > 0, special / F.length(c)).otherwise(F.lit(0.0))


def count_char(c: Column, char: str) -> Column:
    """Occurrences of a one-character string, without a regular expression; bytes are counted, since characters cost a pass."""
    removed = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(char), F.lit("")))
    width = len(char.encode())
    return removed if width == 1 else (removed / width).cast("int")


def normalize_answer(c: Column) -> Column:
    """Lower case, drop ASCII punctuation, drop English articles, collapse whitespace."""
    lowered = F.translate(F.lower(c), PUNCTUATION, "")
    no_articles = F.regexp_replace(lowered, r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(py_words(no_articles), " ")


def _numbered(tokens: Column) -> Column:
    """Each token with its running number among equal ones; linear after the sort."""

    def number(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        ends = lambda fs: F.concat(F.slice(fs, 2, F.size(fs)), F.array(F.size(s) + 1))
        runs = let(firsts, lambda fs: F.zip_with(fs, ends(fs), lambda i, j: F.struct(i.alias("i"), (j - i).alias("n"))))
        each = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), r.n), lambda k: F.concat(F.get(s, r.i - 1), F.lit(" "), k.cast("string"))))
        return F.flatten(each)

    return let(F.sort_array(tokens), number)


def _f1_of_tokens(pred: Column, gold: Column) -> Column:
    # numbered tokens are distinct, so their set intersection is the multiset one
    overlap = F.size(F.array_intersect(_numbered(pred), _numbered(gold)))

    def harmonic(same: Column) -> Column:
        precision, recall = same / F.size(pred), same / F.size(gold)
        return F.when(same == 0, F.lit(0.0)).otherwise((2 * precision * recall) / (precision + recall))

    return let(overlap, harmonic)


def token_f1(prediction: Column, truths: Column) -> Column:
    """Best multiset token F1 of ``prediction`` against an array of accepted answers."""
    pred = F.split(normalize_answer(prediction), " ")

    def one(truth: Column) -> Column:
        tokens = F.struct(pred.alias("p"), F.split(normalize_answer(truth), " ").alias("g"))
        blank = F.array(F.lit(""))
        return let(
            tokens,
            lambda s: F.when((s.p == blank) | (s.g == blank), F.lit(0.0)).otherwise(_f1_of_tokens(s.p, s.g)),
        )

    best = F.array_max(F.transform(F.filter(truths, lambda t: t.isNotNull()), one))
    return F.when(truths.isNull() | (F.coalesce(prediction, F.lit("")) == ""), F.lit(0.0)).otherwise(
        F.coalesce(best, F.lit(0.0))
    )


def complexity(steps: Column, facts: Column, question: Column, answer: Column) -> Column:
    """Multi-hop complexity in [0, 1]: steps 0.4, facts 0.3, question and answer length 0.15 each."""

    def share(n: Column, full: int) -> Column:
        return F.least(n / F.lit(full), F.lit(1.0))

    return (
        share(F.size(steps), 3) * 0.4
        + share(F.size(facts), 3) * 0.3
        + share(word_count(question), 20) * 0.15
        + share(word_count(answer), 50) * 0.15
    )


def iso_time(moment: Column) -> Column:
    """ISO text of a time without zone that is meant as UTC: with six digits of the second if there are any, and a ``Z``."""
    micros = F.date_format(moment, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def utc_now() -> Column:
    """The time of the query in UTC as ISO text, whatever the session's zone is."""
    return iso_time(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp()))

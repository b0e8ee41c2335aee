"""Text and JSON functions against Python's own string and json behaviour."""

import json
import random
import string

import pytest
from pyspark.sql import functions as F

from qaspark.functions import jsontext as J, text as X

SPACES = [chr(c) for c in X.SPACE_CODEPOINTS]


def random_texts(n=300, seed=7):
    rng = random.Random(seed)
    alphabet = list("abcXYZ 0189.,!?'\"-_#ßéÉ中文。!́​\U0001f600") + SPACES
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def one(spark, column, *values):
    """Value of a column over one row of strings a, b, ..."""
    names = string.ascii_lowercase[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_space_set_is_what_python_splits_on():
    import sys

    assert [c for c in range(sys.maxunicode + 1) if chr(c).isspace()] == X.SPACE_CODEPOINTS


def test_strip_and_words_follow_python(spark):
    texts = random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", X.py_strip(F.col("t")).alias("s"), X.py_words(F.col("t")).alias("w"), F.length("t").alias("n")).collect()
    for r in rows:
        assert (r.s, r.w, r.n) == (texts[r.i].strip(), texts[r.i].split(), len(texts[r.i]))


def test_special_ratio_follows_python_classes(spark):
    texts = [t for t in random_texts(seed=3) if t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", X.special_char_ratio(F.col("t")).alias("x")).collect():
        special = sum(not (c.isalnum() or c.isspace()) for c in texts[r.i])
        assert r.x == pytest.approx(special / len(texts[r.i]))
    assert one(spark, X.special_char_ratio(F.col("a")), "") == 0.0


JSON_TEXTS = [
    '{"a":1}', "[1,2]", '"x"', "1", "null", "true", "1.5e3", "-0", "01", '{"a":1,}', "[1,]", "{a:1}", "{'a':1}", "1],[2", "1} {",
    '1, "v": 2', '{"a":1} x', '{"a":1}}', "[1]]", "", "  ", " 1 ", "\t[1]\n", "nul", '"a\nb"', '"\\u00e9"', '"\\x"',
    '{"a":{"b":[1,{"c":"}"}]}}', "// c\n1", "1 // c", "+1", ".5", "1.", '"open', "[", "{", "}", "]", '{"a":1}{"b":2}', " 1",
    '{"a":"\\"}"}', "1}]", "[1}", '{"v":1}', "1e", '{"a" 1}', '{"":1}', "[[[]]]", '""', '"]"', '"}"', "],[", "1,2", '"\t"', "-",
]


def test_strict_json_accepts_what_python_accepts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(JSON_TEXTS)], "i int, t string")
    for r in df.select("i", J.strict_json(F.col("t")).isNotNull().alias("ok")).collect():
        try:
            json.loads(JSON_TEXTS[r.i])
            expected = True
        except ValueError:
            expected = False
        assert r.ok == expected, JSON_TEXTS[r.i]


@pytest.mark.parametrize(
    "value, shown, filled",
    [
        ('"text "', "text", "text"), ("null", "None", ""), ("true", "True", "True"), ("false", "False", ""), ("0", "0", ""),
        ("7", "7", "7"), ("[]", "[]", ""), ("{}", "{}", ""), ('"0"', "0", "0"), ('""', "", ""),
    ],
)
def test_member_texts(spark, value, shown, filled):
    v = J.strict_json(F.col("a"))
    text = '{"k": ' + value + "}"
    assert one(spark, J.text_of(v, "k"), text) == shown
    assert one(spark, J.filled_text_of(v, "k"), text) == filled
    assert one(spark, J.text_of(v, "other"), text) == ""


@pytest.mark.parametrize(
    "response, score",
    [
        ('{"answer_score": 0, "answer_analysis": "x"}', 0), ('{"answer_score": "2"}', 2), ('{"answer_score": 1.9}', 1),
        ('{"answer_score": -1.5}', -1), ('{"answer_score": true}', 1), ('{"answer_score": null}', None), ('{"answer_score": "1.5"}', None),
        ('{"answer_score": [1]}', None), ("{}", None), ("no", None), ("", None), ('```json\n{"answer_score": 1}\n```', 1),
    ],
)
def test_recall_score(spark, response, score):
    assert one(spark, J.recall_score(F.col("a")), response) == score


@pytest.mark.parametrize(
    "response, name",
    [
        ('{"content_identifier": " Apron "}', "Apron"), ('{"content_identifier": ""}', '{"content_identifier": ""}'),
        ("plain name ", "plain name"), ('```json\n{"content_identifier": "x"}```', "x"), ("```fenced```", "fenced"),
    ],
)
def test_content_identifier(spark, response, name):
    assert one(spark, J.content_identifier(F.col("a")), response) == name


@pytest.mark.parametrize(
    "response, grade, feedback",
    [
        ("**Grading**: 4\n**Feedback**: fine\nmore ", 4.0, "fine\nmore"), ("**Grading**:3.5", 3.5, ""), ("nothing", 0.0, ""),
        ("**Grading**: 77\n**Feedback**:\n\n x", 77.0, "x"), ("**Grading**: -2", 0.0, ""),
    ],
)
def test_grade(spark, response, grade, feedback):
    assert one(spark, J.grade(F.col("a")), response) == grade
    assert one(spark, J.feedback(F.col("a")), response) == feedback


def test_f1_edge_cases(spark):
    f1 = X.token_f1(F.col("a"), F.array("b"))
    assert one(spark, f1, "The cat, a dog!", "cat dog") == 1.0
    assert one(spark, f1, "b b c", "b b b") == pytest.approx(2 / 3)
    assert one(spark, f1, "", "x") == 0.0
    assert one(spark, f1, "the", "the") == 0.0
    assert one(spark, X.token_f1(F.col("a"), F.lit(None).cast("array<string>")), "x") == 0.0
    assert one(spark, X.token_f1(F.col("a"), F.array(F.lit(None).cast("string"), F.col("b"))), "x y", "y") == pytest.approx(2 / 3)


def test_normalize_answer_order(spark):
    assert one(spark, X.normalize_answer(F.col("a")), " The U.S.A. -- an  Apple　a ") == "usa apple"
    # punctuation goes first, so "a.n" becomes the article "an" and is dropped
    assert one(spark, X.normalize_answer(F.col("a")), "a.n apple") == "apple"
    assert one(spark, X.normalize_answer(F.col("a")), "éa thé") == "éa thé"


def test_fences_are_found_without_patterns(spark):
    """Fences go by prefix and suffix; only the first opening and the last closing one are fences."""
    cases = [
        ('```json\n{"a": 1}\n```', '{"a": 1}'), ("``````json", "```json"), ("```json```x", "x"), ("``````", ""), ("````", "`"),
        ("`````", "``"), (' ```x``` ', "x"), ("x```", "x"), ("``", "``"), ("", ""), (None, None),
    ]
    frame = spark.createDataFrame(cases, "r string, want string")
    plan = frame.select(J.clean_json_block(F.col("r")), J.json_object_tail(F.col("r")))._jdf.queryExecution().toString()
    assert "regexp" not in plan
    assert [r.got for r in frame.select(J.clean_json_block(F.col("r")).alias("got")).collect()] == [want for _, want in cases]

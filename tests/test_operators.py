"""Operators on small fixtures: the cases the tables do not hold."""

import json

import pytest
from pyspark.sql import Row, functions as F

from qaspark.operators import chunking as K
from qaspark.operators.agentic import DepthQA, WidthQA
from qaspark.operators.atomic import AtomicQA
from qaspark.operators.base import Chain, LimitPerChunk
from qaspark.operators.contexts import MultiHopContexts, info_pairs, passes_gate, sentences
from qaspark.operators.expand import ExpandQA, ThinkQA
from qaspark.operators.generation import CallableGenerator, ExpressionGenerator, TableGenerator, prompt_hash
from qaspark.operators.multihop import MultiHopQA, with_multihop_pairs
from qaspark.operators.score import ScoreQA
from qaspark.operators.singlehop import SingleHopQA, prompt_list, with_pairs
from qaspark.operators.taxonomy import TagChunks
from qaspark.plans import qa as flows
from qaspark.sources.taxonomy import Category, Taxonomy, catalog_text, parse_taxonomy


def fixed(**responses):
    return ExpressionGenerator({stage: F.lit(text) for stage, text in responses.items()})


def texts(spark, *rows):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(rows)], "source_md string, text string")


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


# --- chunking -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, size, overlap", [(13, 5, 2), (10, 5, 0), (11, 5, 0), (5, 5, 4), (1, 5, 4), (0, 5, 1), (9, 1, 0)])
def test_word_windows(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    rows = K.WordChunks(size, overlap)(texts(spark, "　".join(words))).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    covered = [r.chunk_text.split(" ") for r in rows]
    step = size - overlap
    for i, window in enumerate(covered):
        assert window == words[i * step : i * step + size]
    if n:
        assert covered[-1][-1] == words[-1] and all(len(w) == size for w in covered[:-1])
    else:
        assert rows == []


@pytest.mark.parametrize("args", [(0, 0), (5, -1), (5, 5)])
def test_word_window_arguments(args):
    with pytest.raises(ValueError):
        K.WordChunks(*args)


def sections_of(spark, text):
    return [tuple(s) for s in value(spark, K.sections(F.col("t")), text)]


def test_sections(spark):
    text = "# One\n\nIntro here.\n\n## Two\n\nDetail.\n\n### Three  \nLast."
    assert sections_of(spark, text) == [(1, "One", "Intro here."), (2, "Two", "Detail."), (3, "Three", "Last.")]
    assert sections_of(spark, "lead\n# T\nb") == [(0, "", "lead"), (1, "T", "b")]
    assert sections_of(spark, "no # heading\n#tag") == [(0, "", "no # heading\n#tag")]
    assert sections_of(spark, "####### seven\nx") == [(0, "", "####### seven\nx")]
    # the gap between marks and title may cross lines; a blank section below a heading stays
    assert sections_of(spark, "##\n\nTitle\n# B") == [(2, "Title", ""), (1, "B", "")]
    # only a line feed starts a line
    assert sections_of(spark, "a\r# x # y") == [(0, "", "a\r# x # y")]


def groups_of(spark, text, size):
    return value(spark, K.paragraph_groups(F.col("t"), size), text)


def test_paragraph_groups(spark):
    text = "First one.\n\nSecond one.\n\nThird one."
    assert groups_of(spark, text, 25) == ["First one.\n\nSecond one.", "Third one."]
    assert groups_of(spark, text, 500) == [text]
    assert groups_of(spark, " \n ", 5) == []
    # an oversize paragraph is cut at sentence marks, joined without a gap, and never mixed with others
    long = "Ab.Cd!  Ef? Gh。Ij"
    assert groups_of(spark, f"x\n\n{long}\n\ny", 8) == ["x", "Ab.Cd!", "Ef?Gh。", "Ij", "y"]
    # one sentence longer than the limit stays whole
    assert groups_of(spark, "a" * 30 + ". b", 10) == ["a" * 30 + ".", "b"]


def test_semantic_chunks(spark):
    text = "## Rules\n\nFirst premise here.\n\nSecond condition here.\n\n## Tiny\n\nx"
    rows = K.SemanticChunks(500, 20)(texts(spark, text, "  ", "Plain text without any heading.")).collect()
    assert [(r.source_md, r.chunk_index, r.section_title, r.section_level) for r in rows] == [
        ("d0", 0, "Rules", 2), ("d2", 0, "", 0),
    ]
    assert rows[0].chunk_text.startswith("## Rules\n\nFirst")
    with pytest.raises(ValueError):
        K.SemanticChunks(200, 256)


# --- contexts -------------------------------------------------------------------------------------------


def test_chinese_triples(spark):
    parts = ["第一句足够长的前提内容在这里", "第二句足够长的中间内容在这里", "短句一", "第四句同样足够长的内容在这里", "第五句也是足够长的结尾内容"]
    text = "。".join(parts) + "。"
    pairs = value(spark, info_pairs(sentences(F.col("t"), "zh")), text)
    assert [(p.premise, p.conclusion) for p in pairs] == [(parts[0], parts[2])]
    assert pairs[0].related_contexts == [parts[3], parts[4]]
    chunk = texts(spark, text * 3).withColumnsRenamed({"text": "chunk_text"})
    # "auto" counts as Chinese
    out = MultiHopContexts("auto", min_text_length=10)(chunk).orderBy("info_pair_index").collect()
    assert out[0].context == " ".join(parts[:3]) and [r.info_pair_index for r in out] == list(range(len(out)))


def test_gate(spark):
    def gate(t):
        return value(spark, passes_gate(F.col("t")), t)

    assert not gate("too short. really.")
    assert gate("a fair sentence. " * 10)
    assert not gate("no stop at all " * 10)
    assert not gate("#$%^&*. " * 30)
    assert gate("一句话内容。" * 30)


# --- generators -----------------------------------------------------------------------------------------


def test_prompt_lists(spark):
    def read(t):
        return value(spark, prompt_list(F.col("t")), t)

    assert read('["a", " b ", ""]') == ["a", "b"]
    assert read("```json\n[\"a\"]\n```") == ["a"]
    assert read("[who, \"what\", 'when']") == ["who", "what", "when"]
    assert read('{"a": 1}') == read("text") == read("[]") == read("[ ]") == []


def test_pair_forms(spark):
    def read(t):
        df = spark.createDataFrame([(t,)], "response string")
        return [tuple(p) for p in with_pairs(df).first().pairs]

    assert read("Q: first\nA: one\nq: second\na:two") == [("second", "two")]
    assert read('{"qa_pairs": [{"input": "q", "output": "a"}, {"question": "", "answer": "x"}, 3]}') == [("q", "a")]
    assert read('{"qa_pairs": []} \nQ: q\nA: a') == [("q", "a")]
    assert read('[{"question": "q", "answer": "a"}]') == []
    assert read("Q: only") == read("") == []


def test_two_stage_single_hop(spark):
    chunks = spark.createDataFrame(
        [("d", 0, "first chunk"), ("d", 1, "second chunk"), ("d", 2, "  ")], "source_md string, chunk_index int, chunk_text string"
    )
    generator = fixed(instructions='["p1", "p2", "p3"]', pairs="Q: q\nA: a")
    rows = SingleHopQA(generator, 2, "en")(chunks).orderBy("chunk_index", "rec_ord").collect()
    assert [(r.chunk_index, r.generated_prompt) for r in rows] == [(0, "p1"), (0, "p2"), (1, "p1"), (1, "p2")]
    assert {r.qa_type for r in rows} == {"text2qa_meta"} and rows[0].context == "first chunk"


def test_atomic_verified(spark):
    chunks = spark.createDataFrame([("d", 0, "Speed on the apron is at most 25 km/h.")], "source_md string, chunk_index int, chunk_text string")
    responses = dict(
        identifier='{"content_identifier": "apron"}',
        conclusions='[{"conclusion": "at most 25 km/h", "R": "speed limit"}]',
        atomic_question='{"Q": "What is the speed limit?"}',
        refine='{"refined_answer": "25 km/h"}',
        closed_book="30 km/h",
        closed_recall='{"answer_score": 0}',
        open_book="25 km/h",
        open_recall='{"answer_score": 2}',
        alternatives='["25 km/h", "25 kilometres per hour"]',
    )
    (row,) = AtomicQA(fixed(**responses), max_per_task=5, max_question=3)(chunks).collect()
    assert (row.qa_type, row.question, row.answer, row.original_answer) == ("atomic", "What is the speed limit?", "25 km/h", "at most 25 km/h")
    assert row.golden_doc_f1 == 1.0 and "25 km/h" in row.optional_answer
    assert json.loads(row.candidate_tasks_str) == {"conclusion": "at most 25 km/h", "R": "speed limit"}
    known = {**responses, "closed_recall": '{"answer_score": 1}'}
    assert AtomicQA(fixed(**known))(chunks).count() == 0
    lost = {**responses, "open_recall": "?"}
    assert AtomicQA(fixed(**lost))(chunks).count() == 0
    with pytest.raises(ValueError):
        AtomicQA(fixed(), max_per_task=0)


def test_atomic_flow_skips_scores(spark):
    docs = texts(spark, "Speed on the apron is at most 25 km/h.")
    generator = fixed(
        identifier="apron", conclusions='{"conclusion": "c", "R": "r"}', atomic_question='{"Q": "q"}', refine='{"refined_answer": "a"}',
        closed_book="x", closed_recall='{"answer_score": 0}', open_book="a", open_recall='{"answer_score": 1}', alternatives="none",
    )
    stages = flows.markdown_qa(docs, generator, kind="atomic")
    assert stages["qa_scored"].count() == 1
    assert not [c for c in stages["qa_scored"].columns if c.endswith("_grade")]


def test_depth_one_round(spark):
    rows = spark.createDataFrame([("What is the limit?", "25", "context")], "question string, answer string, context string")
    generator = fixed(
        identifier='{"content_identifier": "apron"}', superset='{"identifier": "manual", "relation": "chapter 3"}',
        superset_check='{"new_query": "valid"}', depth_question='{"new_query": "By the manual, what is the limit?"}',
        depth_answer='{"answer_list": ["25"]}', depth_recall='{"answer_score": 0}',
    )
    (row,) = DepthQA(generator, 1)(rows).collect()
    assert (row.qa_type, row.answer, row.depth_round, row.relation) == ("depth", "apron", 1, "chapter 3")
    assert "manual" in row.question
    assert DepthQA(generator, 3)(rows).count() == 3
    # a stricter text than the word "valid" is refused
    other = ExpressionGenerator({**generator.rules, "superset_check": F.lit('{"new_query": "Valid"}')})
    assert DepthQA(other, 1)(rows).count() == 0


def test_width_pair(spark):
    rows = spark.createDataFrame(
        [("s", 0, [0], "Q one?", "A1", "i1"), ("s", 1, [0], "Q two?", "A2", "i2")],
        "source_md string, chunk_index int, rec_ord array<int>, question string, answer string, identifier string",
    )
    generator = fixed(
        identifier="", width_merge='[{"question": "Both?", "index": [0, 1], "content_identifier": "i"}]',
        width_origin='[{"state": 1, "complex_question": "Both of them?"}]', width_answer='[{"llm_answer": "no"}]',
        width_recall='{"answer_score": 0}',
    )
    (row,) = WidthQA(generator)(rows).collect()
    assert (row.question, row.answer, row.source_question_indices) == ("Both of them?", "A1；A2", [0, 1])
    assert [s.question for s in row.source_rows] == row.original_question == ["Q one?", "Q two?"]
    assert WidthQA(generator)(rows.limit(1)).count() == 0


HOP = {
    "question": "How?", "reasoning_steps": [{"step": "one"}, "two", {"step": " "}], "answer": "so", "supporting_facts": ["f1", "", "f2"],
    "type": "t",
}


def hops(spark, response, strict=True):
    df = spark.createDataFrame([(response,)], "response string")
    return with_multihop_pairs(df, strict).first().pairs


def test_multihop_forms(spark):
    (qa,) = hops(spark, json.dumps(HOP))
    assert [s.step for s in qa.reasoning_steps] == ["one", "two"] and qa.supporting_facts == ["f1", "f2"]
    assert hops(spark, json.dumps({**HOP, "supporting_facts": ["f1"]})) == []
    assert hops(spark, json.dumps({k: v for k, v in HOP.items() if k != "type"})) == []
    assert len(hops(spark, json.dumps({"question": "q", "answer": "a"}), strict=False)) == 1
    twice = json.dumps([HOP, {**HOP, "question": " HOW? "}, {**HOP, "question": "Why?"}])
    assert [p.question for p in hops(spark, twice)] == ["How?", "Why?"]


def test_multihop_brace_scan(spark):
    text = json.dumps(HOP)
    assert len(hops(spark, f"Sure: {text} done")) == 1
    assert len(hops(spark, f"{text}\n{json.dumps({**HOP, 'question': 'Next?'})}")) == 2
    # a stray closing brace hides what follows, a brace in quoted text counts as a brace
    assert hops(spark, "}" + text) == []
    assert hops(spark, "x " + json.dumps({**HOP, "answer": "a } b"})) == []
    assert hops(spark, "") == hops(spark, "{{{") == []


def test_multihop_reads_fields_in_one_cast_and_counts_pieces(spark):
    """A response is not taken to tokens, and an object is not asked for one member after the other."""
    df = spark.createDataFrame([(json.dumps(HOP),)], "response string").repartition(1)
    text = with_multihop_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(reasoning_steps,ArrayType(StructType" in text and "regexp_extract_all" not in text


def test_multihop_odd_values_and_many_pairs(spark):
    odd = {"question": True, "reasoning_steps": [{"step": None}, {"step": "true"}, 1.50, {"x": 1}, False], "answer": None, "supporting_facts": [None, 7, "\u3000f "], "type": " t\u00a0"}
    names = [f"Q{i % 45}" if i % 2 else f"q{i % 45} " for i in range(90)]
    sizes = (3, 32, 33, 90)
    texts = [json.dumps(odd), *(json.dumps([{**HOP, "question": q} for q in names[:n]]) for n in sizes)]
    # a name in escapes is a name, a brace in a text of a refused object may begin a group
    texts += ["x " + json.dumps(HOP).replace('"question"', '"\\u0071uestion"'), '{"a": "}", "b": ' + json.dumps(HOP) + "}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string").repartition(1)
    found = [r.pairs for r in with_multihop_pairs(df).orderBy("i").collect()]
    (qa,) = found[0]
    assert (qa.question, qa.answer, qa.type) == ("True", "None", "t")
    assert [s.step for s in qa.reasoning_steps] == ["None", "true", "1.5", "False"] and qa.supporting_facts == ["None", "7", "f"]
    for n, pairs in zip(sizes, found[1:5]):
        assert [p.question.lower() for p in pairs] == [f"q{i}" for i in range(min(n, 45))]
    assert [len(pairs) for pairs in found[5:]] == [1, 1]


def test_braces_after_a_stray_one(spark):
    from qaspark.operators.multihop import braced_objects

    texts = ["a{b}{c{d}}e", "} {x{y}} {z}", "}}{{{p}q}}", "{{u}", "}{{v}w}{", "", "}", "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", braced_objects(F.col("t")).alias("g"))
    assert [r.g for r in rows.orderBy("i").collect()] == [["{b}", "{c{d}}"], ["{y}"], ["{p}"], [], ["{v}"], [], [], ["{}"]]


def test_multihop_limit_and_dedup(spark):
    contexts = spark.createDataFrame(
        [("d", 0, i, f"c{i}") for i in range(5)], "source_md string, chunk_index int, info_pair_index int, context string"
    )
    rule = F.regexp_replace(F.lit(json.dumps(HOP)), "How", F.concat(F.lit("H"), (F.col("info_pair_index") / 2).cast("int").cast("string")))
    rows = MultiHopQA(ExpressionGenerator({"multihop": rule}), "en", num_q=2)(contexts).orderBy("info_pair_index").collect()
    assert [(r.info_pair_index, r.question) for r in rows] == [(0, "H0?"), (2, "H1?")]
    assert 0 < rows[0].complexity <= 1


TAXONOMY = Taxonomy("topic", {"fact": "f"}, (Category("A", "B", "old", "h"), Category("A", "B", "new", "h")), {"direct": "d"})


def test_tags_last_category_wins_and_bad_response(spark):
    chunk = spark.createDataFrame([("d", 0, "text")], "source_md string, chunk_index int, chunk_text string")
    good = '{"tags": [{"level1_name": "A", "level2_name": "B", "task_type": "fact", "reasoning_style": "direct"}]}'
    assert TagChunks(fixed(tags=good), TAXONOMY)(chunk).first().taxonomy_tags[0].focus == "new"
    bad = TagChunks(fixed(tags=""), TAXONOMY)(chunk).first()
    assert bad.taxonomy_tags == [] and bad.tag_status == "failed"
    with pytest.raises(Exception, match="must be a JSON object"):
        TagChunks(fixed(tags=""), TAXONOMY, fail_fast=True)(chunk).collect()


def test_expand_and_think_keep_originals(spark):
    rows = spark.createDataFrame([Row(question="q", answer="a", context="c")])
    done = ExpandQA(fixed(expand='{"expanded_question": "Q", "expanded_answer": "A", "expansion_type": ""}'), "reasoning", "en")(rows)
    thought = ThinkQA(fixed(think='{"think": "t", "answer": "new"}'), "en")(done).first()
    assert (thought.question, thought.answer, thought.expanded_answer) == ("q", "a", "new")
    assert (thought.original_expanded_answer, thought.original_answer, thought.expansion_type) == ("A", None, "reasoning")
    plain = ThinkQA(fixed(think='{"answer": "new"}'), "en")(rows)
    assert (plain.first().answer, plain.first().original_answer, plain.first().think) == ("new", "a", "")
    again = ThinkQA(fixed(think='{"answer": "newer"}'), "en")(plain).first()
    assert (again.answer, again.original_answer) == ("newer", "a")
    assert ThinkQA(fixed(think="?"), "en", keep_failed=False)(rows).count() == 0
    with pytest.raises(ValueError):
        ExpandQA(fixed(), "shorter")


def test_stored_and_called_generators(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    stored = rows.filter("t = 'a'").select(F.lit("s").alias("stage"), prompt_hash(F.col("t"), "sys").alias("prompt_hash"), F.lit("r").alias("response"))
    got = TableGenerator(stored).ask(rows, "s", F.col("t"), "sys").collect()
    assert sorted((r.t, r.response) for r in got) == [("a", "r"), ("a", "r"), ("b", "")]

    def call(prompts, system):
        if prompts == ["b"]:
            raise ConnectionError("refused")
        return [f"{system}:{prompts[0]}"]

    got = CallableGenerator(call, partitions=2).ask(rows.union(spark.createDataFrame([(None,)], "t string")), "s", F.col("t"), "sys").collect()
    assert sorted((r.t or "", r.response, r.gen_status) for r in got) == [
        ("", "", "skipped"), ("a", "sys:a", "ok"), ("a", "sys:a", "ok"), ("b", "", "failed"),
    ]

    def broken(prompts, system):
        raise ValueError("payload")

    with pytest.raises(Exception, match="payload"):
        CallableGenerator(broken).ask(rows, "s", F.col("t"))


def test_each_prompt_is_called_once(spark, tmp_path):
    marks = str(tmp_path)

    def call(prompts, system):
        import os
        import uuid

        open(os.path.join(marks, f"{prompts[0]}-{uuid.uuid4().hex}"), "w").close()
        return [prompts[0]]

    rows = spark.range(20).select(F.col("id").cast("string").alias("t"))
    asked = CallableGenerator(call, partitions=4).ask(rows, "s", F.col("t"))
    assert asked.count() == 20 and asked.filter("response <> ''").count() == 20 and asked.groupBy("response").count().count() == 20
    assert len(list(tmp_path.iterdir())) == 20


def test_scores_from_a_called_model(spark):
    rows = spark.createDataFrame([("c", "q1", "a"), ("c", "q2", "a")], "chunk_text string, question string, answer string")

    def call(prompts, system):
        if "search index" in prompts[0]:
            raise TimeoutError
        return [f"**Grading**: {4 if 'q1' in prompts[0] else 2}\n**Feedback**: {system}"]

    scored = ScoreQA(CallableGenerator(call, partitions=2), "en", "sys")(rows).orderBy("question").collect()
    assert [(r.question_quality_grade, r.answer_verifiability_grade, r.downstream_value_grade) for r in scored] == [(4, 4, 0), (2, 2, 0)]
    assert scored[0].question_quality_feedback == "sys" and scored[0].downstream_value_feedback == ""
    assert "response" not in scored[0].asDict()


def test_chain_and_limit(spark):
    rows = spark.createDataFrame([("s", 0, [i]) for i in range(5)], "source_md string, chunk_index int, rec_ord array<int>")
    kept = Chain([LimitPerChunk(3), lambda df: df.filter(F.get("rec_ord", F.lit(0)) > 0)])(rows)
    assert sorted(r.rec_ord for r in kept.collect()) == [[1], [2]]
    with pytest.raises(ValueError):
        LimitPerChunk(0)


def test_taxonomy_config():
    config = {"taxonomy": {"topic": " ", "task_type": {"f": 1}, "level1_name": {"A": [{"level2_name": "B", "focus": "x", "prompt_hint": "y"}]}, "reasoning_style": {"d": "e"}}}
    t = parse_taxonomy(config)
    assert t.is_complete() and t.topic == "民航领域" and t.task_type == {"f": "1"}
    assert catalog_text(t).splitlines()[1] == "A > B | x | y"
    assert not parse_taxonomy({}).is_complete()
    for bad in ({"taxonomy": []}, {"taxonomy": {"task_type": []}}, {"taxonomy": {"level1_name": {"A": {}}}}, {"taxonomy": {"level1_name": {"A": [1]}}}):
        with pytest.raises(ValueError):
            parse_taxonomy(bad)
    with pytest.raises(ValueError):
        flows.markdown_qa(None, None, kind="taxonomy", taxonomy=Taxonomy())


def test_review_flow_adds_depth_and_width(spark):
    """Depth and width of a job work on its generated rows; the session is the same with or without them."""
    from checks.model import model
    from checks.registry import documents
    from qaspark.plans import qa as flows
    from tests.conftest import SMALL

    docs = documents(spark, SMALL).limit(60)
    generator = model("singlehop", "scores", "depth", "width")
    stages = flows.review_flow(docs, generator, "s", min_score=3.0, language="en", question_num=2, add_depth=True, depth_rounds=1, add_width=True)
    assert set(stages) == {"session", "depth", "width"}
    plain = flows.review_session(docs, generator, "s", min_score=3.0, language="en", question_num=2)
    assert sorted(stages["session"].select("id", "question").collect()) == sorted(plain.select("id", "question").collect())
    assert {"depth_round", "new_identifier"} <= set(stages["depth"].columns) and stages["depth"].count() > 0
    assert "original_question" in stages["width"].columns and stages["width"].count() > 0


def test_review_flow_with_width_makes_its_rows_once(spark):
    """The rows that are scored are read from where the rows of the width stage are written."""
    from checks.model import model

    asked = spark.sparkContext.accumulator(0)

    def counted(text):
        asked.add(1)
        return '["Ask who acts"]'

    docs = spark.createDataFrame([(f"d{i}", f"word{i} and {i} more") for i in range(12)], "source_md string, text string")
    rules = model("singlehop", "scores", "width").rules
    generator = ExpressionGenerator({**rules, "instructions": F.udf(counted, "string").asNondeterministic()("chunk_text")})
    stages = flows.review_flow(docs, generator, "s", min_score=3.0, language="en", add_width=True)
    stages["session"].collect()
    stages["width"].collect()
    assert asked.value == 12

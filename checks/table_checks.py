"""Filters, limits, duplicates and exports over record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import DOCS_SQL, PAIRS_SQL, bigs, check, conversation_pairs, documents, strip, table
from qaspark.functions.text import is_blank
from qaspark.operators import export
from qaspark.operators.base import LimitPerChunk, first_per_group
from qaspark.operators.filters import GradeFilter, export_scope, final_pair, overall_score, review_flag, review_list
from qaspark.operators.multihop import FirstByQuestion


def lines(spark, sf):
    """All lines of all documents, numbered."""
    docs = documents(spark, sf)
    return docs.select("source_md", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = (
    f"{DOCS_SQL}, lines AS (SELECT source_md, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, "
    "unnest(string_split(text, chr(10))) AS line FROM docs)"
)


@check("nonblank_filter", "F1", f"WITH {LINES_SQL} SELECT source_md, line_no FROM lines WHERE {strip('line')} <> ''")
def nonblank_filter(spark, sf):
    return bigs(lines(spark, sf).filter(~is_blank(F.col("line"))).select("source_md", "line_no"))


def graded(spark, sf):
    """Conversation pairs with grades, some of them missing."""
    rows = conversation_pairs(spark, sf)
    q, a = F.length("question"), F.length("answer")
    return rows.withColumns(
        {
            "question_quality_grade": (q % 5 + 1).cast("double"),
            "answer_alignment_grade": F.when(a % 6 != 0, (a % 5 + 1).cast("double")),
            "answer_verifiability_grade": F.when(q % 4 != 0, ((q + a) % 5 + 1).cast("double")),
            "downstream_value_grade": F.lit(None).cast("double"),
            "deleted": q % 9 == 0,
            "expanded_question": F.when(q % 3 == 0, F.lit("")).when(q % 3 == 1, F.reverse("question")),
            "expanded_answer": F.when(a % 3 == 0, F.lit("")).when(a % 3 == 1, F.reverse("answer")),
            "think": F.when(q % 2 == 0, F.lit("why")),
            "id": F.concat("source_md", F.lit("/"), "chunk_index"),
        }
    ).withColumn("filter_passed", F.when(F.length("question") % 7 != 0, F.length("answer") % 2 == 0))


GRADED_SQL = (
    f"{PAIRS_SQL}, g AS (SELECT *, (length(question) % 5 + 1)::DOUBLE AS g1, CASE WHEN length(answer) % 6 <> 0 THEN (length(answer) % 5 + 1)::DOUBLE END AS g2, "
    "CASE WHEN length(question) % 4 <> 0 THEN ((length(question) + length(answer)) % 5 + 1)::DOUBLE END AS g3, length(question) % 9 = 0 AS deleted, "
    "CASE length(question) % 3 WHEN 0 THEN '' WHEN 1 THEN reverse(question) END AS eq, CASE length(answer) % 3 WHEN 0 THEN '' WHEN 1 THEN reverse(answer) END AS ea, "
    "CASE WHEN length(question) % 2 = 0 THEN 'why' END AS think, source_md || '/' || chunk_index AS id, "
    "CASE WHEN length(question) % 7 <> 0 THEN length(answer) % 2 = 0 END AS fp FROM qa)"
)
KEY = ["source_md", "chunk_index"]


@check("grade_filter", "F2", f"WITH {GRADED_SQL} SELECT source_md, chunk_index FROM g WHERE g1 >= 2 AND coalesce(g2, 0) >= 2")
def grade_filter(spark, sf):
    return bigs(GradeFilter(2, 2)(graded(spark, sf)).select(*KEY))


@check(
    "grade_filter_all",
    "F3",
    f"WITH {GRADED_SQL} SELECT source_md, chunk_index FROM g WHERE g1 >= 2 AND coalesce(g2, 0) >= 2 AND coalesce(g3, 0) >= 2",
)
def grade_filter_all(spark, sf):
    rows = graded(spark, sf).withColumn("downstream_value_grade", F.lit(2.0))
    return bigs(GradeFilter.all_at(2)(rows).select(*KEY))


@check(
    "review_flags",
    "F4",
    f"WITH {GRADED_SQL} SELECT source_md, chunk_index, g1 >= 3 AND coalesce(g2 >= 3, true) AND coalesce(g3 >= 3, true) AS passed FROM g",
)
def review_flags(spark, sf):
    rows = graded(spark, sf)
    return bigs(rows.select(*KEY, review_flag(rows, 3.0).alias("passed")))


@check(
    "overall_score",
    "A4",
    f"WITH {GRADED_SQL} SELECT source_md, chunk_index, round((g1 + coalesce(g2, 0) + coalesce(g3, 0)) / (1 + (g2 IS NOT NULL)::INT + (g3 IS NOT NULL)::INT), 6)::DOUBLE AS score FROM g",
)
def overall(spark, sf):
    rows = graded(spark, sf)
    return bigs(rows.select(*KEY, overall_score(rows).alias("score")))


@check(
    "review_list",
    "F13 R15",
    f"WITH {GRADED_SQL} SELECT 'passed' AS list, id FROM g WHERE NOT deleted AND coalesce(fp, true) AND contains(lower(question), 'the') "
    "UNION ALL SELECT 'flagged', id FROM g WHERE NOT deleted AND NOT coalesce(fp, true) UNION ALL SELECT 'all', id FROM g WHERE NOT deleted",
)
def review_lists(spark, sf):
    rows = graded(spark, sf)
    views = {"passed": review_list(rows, "passed", "The"), "flagged": review_list(rows, "flagged"), "all": review_list(rows)}
    out = None
    for name, view in views.items():
        part = view.select(F.lit(name).alias("list"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@check(
    "export_scope",
    "F14",
    f"WITH {GRADED_SQL} SELECT 'passed' AS scope, id FROM g WHERE NOT deleted AND coalesce(fp, true) UNION ALL SELECT 'all', id FROM g WHERE NOT deleted "
    "UNION ALL SELECT 'selected', id FROM g WHERE NOT deleted AND g1 >= 4 UNION ALL SELECT 'selected none', id FROM g WHERE NOT deleted",
)
def export_scopes(spark, sf):
    rows = graded(spark, sf)
    chosen = rows.filter("question_quality_grade >= 4").select("id")
    views = {
        "passed": export_scope(rows), "all": export_scope(rows, "all"), "selected": export_scope(rows, "selected", chosen),
        "selected none": export_scope(rows, "selected"),
    }
    out = None
    for name, view in views.items():
        part = view.select(F.lit(name).alias("scope"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@check(
    "final_pair",
    "F16",
    f"WITH {GRADED_SQL} SELECT id, coalesce(nullif(eq, ''), question) AS question, coalesce(nullif(ea, ''), answer) AS answer FROM g",
)
def final_pairs(spark, sf):
    rows = graded(spark, sf)
    question, answer = final_pair(rows)
    return rows.select("id", question.alias("question"), answer.alias("answer"))


@check(
    "alpaca_export",
    "E1 S13",
    f"WITH {GRADED_SQL} SELECT 'Please answer the following question based on the provided information.' AS instruction, "
    "coalesce(nullif(eq, ''), question) AS input, coalesce(nullif(ea, ''), answer) AS output, source_md, chunk_index, think FROM g",
)
def alpaca_export(spark, sf):
    return bigs(export.AlpacaExport()(graded(spark, sf)))


def _chat_sql(*turns: tuple[str, str]) -> str:
    said = " || ' # ' || ".join(f"'{who}: ' || {what}" for who, what in turns)
    return f"WITH {PAIRS_SQL} SELECT source_md, chunk_index, {said} AS chat FROM qa WHERE trim(question) <> '' AND trim(answer) <> ''"


@check("sharegpt_export", "E4", _chat_sql(("human", "chunk_text || chr(10) || chr(10) || question"), ("gpt", "answer")))
def sharegpt_export(spark, sf):
    rows = export.ChatExport("sharegpt", context=True)(conversation_pairs(spark, sf))
    said = F.transform("conversations", lambda t: F.concat(t["from"], F.lit(": "), t["value"]))
    return bigs(rows.select("source_md", "chunk_index", F.array_join(said, " # ").alias("chat")))


@check("chatml_export", "E4", _chat_sql(("system", "'Be brief.'"), ("user", "question"), ("assistant", "answer")))
def chatml_export(spark, sf):
    rows = export.ChatExport("chatml", "Be brief.")(conversation_pairs(spark, sf))
    said = F.transform("messages", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return bigs(rows.select("source_md", "chunk_index", F.array_join(said, " # ").alias("chat")))


@check(
    "multihop_export",
    "E2",
    f"WITH {GRADED_SQL} SELECT 'Answer the multi-hop question using the provided supporting facts.' AS instruction, question AS input, answer AS output, "
    "source_md, chunk_index, 'why' AS steps, '' AS facts, CASE WHEN think IS NULL THEN '' ELSE 'kind' END AS type, 0.0::DOUBLE AS complexity FROM g",
)
def multihop_export(spark, sf):
    steps = F.array(F.struct(F.lit("why").alias("step")))
    rows = graded(spark, sf).withColumns(
        {
            "reasoning_steps": steps,
            "supporting_facts": F.lit(None).cast("array<string>"),
            "qa_type": F.when(F.col("think").isNotNull(), F.lit("kind")),
        }
    )
    out = export.MultiHopExport()(rows)
    return bigs(
        out.select(
            "instruction", "input", "output", "source_md", "chunk_index",
            F.array_join(F.transform("metadata.reasoning_steps", lambda s: s.step), ",").alias("steps"),
            F.array_join("metadata.supporting_facts", ",").alias("facts"), F.col("metadata.type").alias("type"),
            F.col("metadata.complexity").alias("complexity"),
        )
    )


@check(
    "session_export",
    "E3",
    f"WITH {GRADED_SQL} SELECT '根据给定上下文回答问题。' AS instruction, coalesce(nullif(eq, ''), question) AS input, "
    "coalesce(nullif(ea, ''), answer) AS output, source_md, chunk_index, think FROM g WHERE NOT deleted AND coalesce(fp, true)",
)
def session_export(spark, sf):
    return bigs(export.session_export(graded(spark, sf)))


@check(
    "limit_per_chunk",
    "L1",
    f"WITH {LINES_SQL} SELECT source_md, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY source_md ORDER BY line_no) AS rn FROM lines) WHERE rn <= 3",
)
def limit_per_chunk(spark, sf):
    rows = lines(spark, sf).withColumns({"chunk_index": F.lit(None).cast("int"), "rec_ord": F.array("line_no")})
    return bigs(LimitPerChunk(3)(rows).select("source_md", "line_no", "line"))


@check(
    "limit_per_status",
    "L1",
    "SELECT l_linestatus, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 2500",
)
def limit_per_status(spark, sf):
    """Two groups hold all rows, and both are cut above the optimizer's threshold."""
    rows = table(spark, sf, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey")
    return bigs(first_per_group(rows, ["l_linestatus"], [F.desc("l_orderkey"), "l_linenumber", "l_partkey"], 2500))


@check(
    "limit_per_source",
    "L1",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 1500",
)
def limit_per_source(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return first_per_group(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 1500).select("source", "doc_id")


@check(
    "first_by_question",
    "W2",
    f"WITH {LINES_SQL}, n AS (SELECT *, lower({strip('line')}) AS norm FROM lines) SELECT source_md, line_no, line FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY norm ORDER BY source_md, line_no) AS rn FROM n WHERE norm <> '') WHERE rn = 1",
)
def first_by_question(spark, sf):
    rows = lines(spark, sf).withColumn("question", F.col("line"))
    return bigs(FirstByQuestion((), ("source_md", "line_no"))(rows).select("source_md", "line_no", "line"))


@check(
    "first_by_question_in_chunk",
    "W2 W3",
    f"WITH {LINES_SQL}, n AS (SELECT *, lower({strip('line')}) AS norm FROM lines) SELECT source_md, line_no FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY source_md, norm ORDER BY line_no) AS rn FROM n WHERE norm <> '') WHERE rn = 1",
)
def first_by_question_in_chunk(spark, sf):
    rows = lines(spark, sf).withColumn("question", F.col("line"))
    return bigs(FirstByQuestion(("source_md",), ("line_no",))(rows).select("source_md", "line_no"))


@check("sorted_listing", "O1", "SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS pos FROM pages")
def sorted_listing(spark, sf):
    from qaspark.operators.ordering import dense_index

    return dense_index(table(spark, sf, "pages").select("url", "page_id"), ["url", "page_id"], "pos").select("url", "pos")



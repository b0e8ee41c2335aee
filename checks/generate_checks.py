"""Question generation, scoring, expansion and whole flows over all documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.chunk_checks import contexts_sql, packing_sql, semantic_sql
from checks.model import model
from checks.registry import PAIRS_SQL, bigs, check, chunks_sql, conversation_pairs, documents, headed_documents, strip, table
from checks.scalar_checks import norm_sql
from qaspark.operators import prompts as P
from qaspark.operators.agentic import DepthQA, WidthQA
from qaspark.operators.atomic import AtomicQA
from qaspark.operators.chunking import WordChunks
from qaspark.operators.contexts import MultiHopContexts
from qaspark.operators.expand import ExpandQA, ThinkQA
from qaspark.operators.filters import GradeFilter
from qaspark.operators.generation import CallableGenerator, TableGenerator, prompt_hash
from qaspark.operators.multihop import MultiHopQA, with_multihop_pairs
from qaspark.operators.score import ScoreQA
from qaspark.operators.singlehop import SingleHopQA
from qaspark.operators.summary import stage_counts
from qaspark.operators.taxonomy import TagChunks, TaxonomyAnswers, TaxonomyQuestions
from qaspark.plans import qa as flows
from qaspark.schemas import DIMENSIONS
from qaspark.sources.taxonomy import Category, Taxonomy, catalog_text

SHOWN = ["source_md", "chunk_index", "question", "answer"]


def text_list(column: str):
    return F.array_join(column, " | ")


def steps_text(column: str = "reasoning_steps"):
    return F.array_join(F.transform(column, lambda s: s.step), " | ")


# --- single-hop -------------------------------------------------------------------------------------

SINGLE_SQL = (
    f"{chunks_sql()}, asked AS (SELECT *, length(chunk_text) AS n, CASE length(chunk_text) % 5 "
    "WHEN 0 THEN ['Ask who acts', 'Ask what follows'] WHEN 1 THEN ['Ask who acts', 'Ask when'] "
    "WHEN 2 THEN ['Ask where', 'Ask why'] ELSE CAST([] AS VARCHAR[]) END AS ps FROM chunks), "
    "gen AS (SELECT source_md, chunk_index, chunk_text, n, unnest(generate_series(0, len(ps) - 1)) AS i, unnest(ps) AS g FROM asked "
    "WHERE len(ps) > 0), "
    "told AS (SELECT *, (n + length(g)) % 4 AS m, g || ' in ' || n || ' characters?' AS q, md5(chunk_text) AS a FROM gen), "
    "pairs AS (SELECT source_md, chunk_index, chunk_text, g, i, 0 AS j, q AS question, a AS answer FROM told WHERE m < 3 "
    "UNION ALL SELECT source_md, chunk_index, chunk_text, g, i, 1, q || ' More?', a || ' more' FROM told WHERE m = 0), "
    "single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_md, chunk_index ORDER BY i, j) AS rn FROM pairs) WHERE rn <= 2)"
)


@check(
    "singlehop_qa",
    "Q1 L1 G2 J1",
    f"WITH {SINGLE_SQL} SELECT source_md, chunk_index, question, answer, g AS generated_prompt, chunk_text AS context, "
    "'singlehop' AS hop_type, 'text2qa_meta' AS qa_type, 0::BIGINT AS n_steps FROM single",
)
def singlehop_qa(spark, sf):
    rows = SingleHopQA(model("singlehop"), 2, "en")(WordChunks()(documents(spark, sf)))
    return bigs(
        rows.select(*SHOWN, "generated_prompt", "context", "hop_type", "qa_type", F.size("reasoning_steps").alias("n_steps"))
    )


# --- scores, expansion, reasoning ---------------------------------------------------------------------


def scores_sql(source: str, to: str = "scored") -> str:
    """``to`` = ``source`` (question, answer, chunk_text) with four grades and feedback texts."""
    parts = []
    for k, name in enumerate(DIMENSIONS):
        grade = f"((length(question) * {k + 1} + length(answer) + length(chunk_text)) % 5 + 1)"
        blank = f"(length(question) + {k}) % 7 = 0"
        parts.append(f"CASE WHEN {blank} THEN 0.0 WHEN {grade} = 3 THEN 3.5 ELSE {grade} END::DOUBLE AS {name}_grade")
        parts.append(f"CASE WHEN {blank} THEN '' ELSE 'seen ' || length(answer) || chr(10) || 'end' END AS {name}_feedback")
    return f"{to} AS (SELECT *, {', '.join(parts)} FROM {source})"


GRADES = [f"{d}_grade" for d in DIMENSIONS]
FEEDBACK = [f"{d}_feedback" for d in DIMENSIONS]


@check(
    "score_qa",
    "Q23 P26",
    f"WITH {PAIRS_SQL}, {scores_sql('qa')} SELECT source_md, chunk_index, {', '.join(GRADES + FEEDBACK)} FROM scored",
)
def score_qa(spark, sf):
    return bigs(ScoreQA(model("scores"), "en")(conversation_pairs(spark, sf)).select("source_md", "chunk_index", *GRADES, *FEEDBACK))


def expand_sql(source: str, mode: str = "detail", to: str = "expanded") -> str:
    h = "((length(question) + length(answer)) % 5)"
    return (
        f"{to} AS (SELECT *, CASE WHEN {h} < 2 THEN trim('More: ' || question) END AS expanded_question, "
        f"CASE WHEN {h} < 2 THEN {strip('answer || ' + chr(39) + ' [grounded]' + chr(39))} END AS expanded_answer, "
        f"CASE {h} WHEN 0 THEN 'contextual' WHEN 1 THEN '{mode}' END AS expansion_type, "
        f"CASE {h} WHEN 0 THEN 'kept' WHEN 1 THEN '' END AS expansion_notes, "
        f"CASE WHEN {h} < 2 THEN 'ok' ELSE 'failed' END AS expansion_status, "
        f"CASE {h} WHEN 2 THEN 'the expansion response holds no JSON object' "
        "WHEN 3 THEN 'the expansion lacks its question or its answer' "
        f"WHEN 4 THEN 'Expansion response is not one valid JSON object' END AS expansion_error FROM {source})"
    )


EXPANDED = [
    "expanded_question", "expanded_answer", "expansion_type", "expansion_notes", "expansion_status", "expansion_error",
]


@check(
    "expand_qa",
    "Q21 F12 P24",
    f"WITH {PAIRS_SQL}, {expand_sql('qa', 'reasoning')} SELECT source_md, chunk_index, {', '.join(EXPANDED)} FROM expanded",
)
def expand_qa(spark, sf):
    done = ExpandQA(model("edits"), "reasoning", "en")(conversation_pairs(spark, sf))
    return bigs(done.select("source_md", "chunk_index", *EXPANDED))


@check(
    "expand_qa_drop_failed",
    "F12",
    f"WITH {PAIRS_SQL}, {expand_sql('qa')} SELECT source_md, chunk_index, expanded_question FROM expanded WHERE expansion_status = 'ok'",
)
def expand_qa_drop_failed(spark, sf):
    done = ExpandQA(model("edits"), "detail", "auto", keep_failed=False)(conversation_pairs(spark, sf))
    return bigs(done.select("source_md", "chunk_index", "expanded_question"))


def think_sql(source: str, to: str = "thought") -> str:
    """Reasoning on top of ``expanded_*`` columns; the stand-in looks at the plain question and answer."""
    h = "((length(question) + 2 * length(answer)) % 4)"
    use = "(coalesce(expanded_question, '') <> '' OR coalesce(expanded_answer, '') <> '')"
    new = f"(CASE {h} WHEN 0 THEN {strip(chr(39) + 'New: ' + chr(39) + ' || answer')} WHEN 2 THEN {strip('question')} ELSE '' END)"
    return (
        f"{to} AS (SELECT * EXCLUDE (answer, expanded_answer), CASE WHEN {h} = 0 THEN 'because' ELSE '' END AS think, "
        f"CASE WHEN {h} < 3 THEN 'ok' ELSE 'failed' END AS think_status, "
        f"CASE WHEN {h} = 3 THEN 'the think response holds no JSON object' END AS think_error, "
        f"CASE WHEN {h} < 3 AND {use} THEN coalesce(expanded_answer, '') END AS original_expanded_answer, "
        f"CASE WHEN {h} < 3 AND NOT {use} THEN answer END AS original_answer, "
        f"CASE WHEN {h} < 3 AND NOT {use} AND {new} <> '' THEN {new} ELSE answer END AS answer, "
        f"CASE WHEN {h} < 3 AND {use} AND {new} <> '' THEN {new} ELSE expanded_answer END AS expanded_answer FROM {source})"
    )


THOUGHT = ["think", "think_status", "think_error", "original_expanded_answer", "original_answer", "answer", "expanded_answer"]


@check(
    "think_qa",
    "Q22 P25 F16",
    f"WITH {PAIRS_SQL}, {expand_sql('qa')}, {think_sql('expanded')} SELECT source_md, chunk_index, {', '.join(THOUGHT)} FROM thought",
)
def think_qa(spark, sf):
    expanded = ExpandQA(model("edits"), "detail", "en")(conversation_pairs(spark, sf))
    return bigs(ThinkQA(model("edits"), "en")(expanded).select("source_md", "chunk_index", *THOUGHT))


# --- atomic -------------------------------------------------------------------------------------------

ATOMIC_SQL = (
    f"{chunks_sql()}, base AS (SELECT *, length(chunk_text) AS n FROM chunks), "
    "tasks AS (SELECT *, CASE n % 3 WHEN 0 THEN 'id-' || n WHEN 1 THEN 'subject ' || n ELSE '{\"content_identifier\": \"\"}' END AS identifier, "
    "CASE n % 4 WHEN 3 THEN 1 ELSE 0 END AS i, "
    "CASE n % 4 WHEN 0 THEN 'fact one of ' || n WHEN 1 THEN 'lone fact ' || n WHEN 3 THEN 'the fact after ' || n END AS conclusion, "
    "CASE n % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'lone' WHEN 3 THEN 'order' END AS r FROM base WHERE n % 4 <> 2), "
    "quest AS (SELECT *, 'Which value is ' || conclusion || '?' AS question, upper(conclusion) AS refined FROM tasks WHERE length(conclusion) % 5 <> 0), "
    "kept AS (SELECT * FROM quest WHERE length(question) % 7 <> 0 AND (length(question) + n) % 4 < 2 AND n % 3 < 2), "
    f"shaped AS (SELECT *, refined || ', and more!' AS golden, CASE WHEN n % 2 = 0 THEN [refined, 'The ' || lower(refined)] ELSE [refined] END AS opts, "
    f"len(string_split({norm_sql('refined')}, ' ')) AS k FROM kept)"
)


@check(
    "atomic_qa",
    "Q4 Q5 Q6 Q7 Q8 Q9 Q10 L1",
    f"WITH {ATOMIC_SQL} SELECT source_md, chunk_index, question, refined AS answer, conclusion AS original_answer, identifier, "
    "refined AS refined_answer, 'guess ' || length(question) AS llm_answer, 0::BIGINT AS llm_recall_score, golden AS golden_doc_answer, "
    "(CASE n % 3 WHEN 0 THEN 2 ELSE 1 END)::BIGINT AS golden_doc_recall_score, array_to_string(opts, ' | ') AS optional_answer, "
    "round(2 * (k / (k + 2)::DOUBLE) / (k / (k + 2)::DOUBLE + 1), 6) AS golden_doc_f1, 'atomic' AS qa_type, "
    "'{\"conclusion\":\"' || conclusion || '\",\"R\":\"' || r || '\"}' AS candidate_tasks_str FROM shaped",
)
def atomic_qa(spark, sf):
    rows = AtomicQA(model("atomic"), max_per_task=2, max_question=1)(WordChunks()(documents(spark, sf)))
    return bigs(
        rows.select(
            *SHOWN, "original_answer", "identifier", "refined_answer", "llm_answer", "llm_recall_score", "golden_doc_answer",
            "golden_doc_recall_score", text_list("optional_answer").alias("optional_answer"), "golden_doc_f1", "qa_type",
            "candidate_tasks_str",
        )
    )


# --- taxonomy -----------------------------------------------------------------------------------------

TAXONOMY = Taxonomy(
    topic="Text collections",
    task_type={"fact": "states a fact", "compare": "compares two things"},
    categories=(
        Category("Form", "Short", "brevity", "ask about short texts"),
        Category("Form", "Long", "length", "ask about long texts"),
        Category("Content", "Facts", "facts", "ask for one fact"),
        Category("Content", "Order", "order", "ask what comes first"),
    ),
    reasoning_style={"direct": "no steps", "chain": "several steps"},
)

TAGS_SQL = (
    f"{chunks_sql()}, base AS (SELECT *, length(chunk_text) AS n FROM chunks), "
    "tags AS (SELECT source_md, chunk_index, chunk_text, n, 0 AS i, 'Form' AS level1_name, CASE WHEN n < 1000 THEN 'Short' ELSE 'Long' END AS level2_name, "
    "'fact' AS task_type, 'direct' AS reasoning_style, CASE WHEN n < 1000 THEN 'brevity' ELSE 'length' END AS focus, "
    "CASE WHEN n < 1000 THEN 'ask about short texts' ELSE 'ask about long texts' END AS prompt_hint FROM base WHERE n % 4 = 0 "
    "UNION ALL SELECT source_md, chunk_index, chunk_text, n, 1, 'Content', 'Facts', 'compare', 'chain', 'facts', 'ask for one fact' FROM base WHERE n % 4 = 0 "
    "UNION ALL SELECT source_md, chunk_index, chunk_text, n, 0, 'Content', 'Order', 'fact', 'direct', 'order', 'ask what comes first' FROM base WHERE n % 4 = 1)"
)
_TAG_COLUMNS = ["level1_name", "level2_name", "task_type", "reasoning_style", "focus", "prompt_hint"]


@check(
    "taxonomy_tags",
    "Q11 J2 J3",
    f"WITH {TAGS_SQL} SELECT b.source_md, b.chunk_index, CASE WHEN b.n % 4 = 2 THEN 'failed' ELSE 'ok' END AS tag_status, "
    f"coalesce(t.i, -1)::BIGINT AS i, {', '.join('t.' + c for c in _TAG_COLUMNS)} FROM base b LEFT JOIN tags t USING (source_md, chunk_index)",
)
def taxonomy_tags(spark, sf):
    tagged = TagChunks(model("taxonomy"), TAXONOMY, "en")(WordChunks()(documents(spark, sf)))
    each = tagged.select("source_md", "chunk_index", "tag_status", F.posexplode_outer("taxonomy_tags").alias("i", "t"))
    return bigs(each.select("source_md", "chunk_index", "tag_status", F.coalesce("i", F.lit(-1)).alias("i"), "t.*"))


TAXQ_SQL = (
    f"{TAGS_SQL}, tq AS (SELECT *, 'What about ' || level2_name || ' in ' || n || '?' AS question FROM tags WHERE (length(level2_name) + n) % 3 <> 0)"
)


@check(
    "taxonomy_questions",
    "Q12",
    f"WITH {TAXQ_SQL} SELECT source_md, chunk_index, question, task_type AS qa_type, chunk_text AS context, {', '.join(_TAG_COLUMNS)} FROM tq",
)
def taxonomy_questions(spark, sf):
    tagged = TagChunks(model("taxonomy"), TAXONOMY, "en")(WordChunks()(documents(spark, sf)))
    rows = TaxonomyQuestions(model("taxonomy"), TAXONOMY, "en")(tagged)
    return bigs(rows.select("source_md", "chunk_index", "question", "qa_type", "context", *_TAG_COLUMNS))


TAXA_SQL = f"{TAXQ_SQL}, ta AS (SELECT *, 'Answer ' || md5(chunk_text) AS answer FROM tq WHERE length(question) % 4 <> 0)"


@check("taxonomy_answers", "Q13", f"WITH {TAXA_SQL} SELECT source_md, chunk_index, question, answer, level1_name FROM ta")
def taxonomy_answers(spark, sf):
    generator = model("taxonomy")
    tagged = TagChunks(generator, TAXONOMY, "en")(WordChunks()(documents(spark, sf)))
    rows = TaxonomyAnswers(generator, TAXONOMY, "en")(TaxonomyQuestions(generator, TAXONOMY, "en")(tagged))
    return bigs(rows.select(*SHOWN, "level1_name"))


# --- multi-hop ----------------------------------------------------------------------------------------


def hops_sql(ctx: str) -> str:
    """CTEs from a context table to ``found``: valid pairs of each response after its own dedup."""
    clean = {c: f"translate({c}, '{{}}', '')" for c in ("premise", "intermediate", "conclusion")}
    stripped = {c: strip(e) for c, e in clean.items()}
    return (
        f"told AS (SELECT *, length(context) % 5 AS m, 'How do ' || length(premise) || ' and ' || length(intermediate) || ' meet?' AS q FROM {ctx}), "
        "found AS (SELECT source_md, chunk_index, info_pair_index, 0 AS j, q AS question, conclusion AS answer, "
        "premise || ' | ' || intermediate AS steps, 2 AS n_steps, premise || ' | ' || intermediate AS facts, 2 AS n_facts, 'chain' AS qa_type FROM told WHERE m IN (0, 1) "
        f"UNION ALL SELECT source_md, chunk_index, info_pair_index, 0, q, {stripped['conclusion']}, {stripped['premise']} || ' | ' || {stripped['intermediate']}, 2, "
        f"{stripped['premise']} || ' | ' || {stripped['intermediate']}, 2, 'chain' FROM told WHERE m = 2 "
        f"UNION ALL SELECT source_md, chunk_index, info_pair_index, 1, 'Second?', {stripped['conclusion']}, {stripped['intermediate']} || ' | ' || {stripped['premise']}, 2, "
        f"{stripped['intermediate']} || ' | ' || {stripped['premise']}, 2, 'pair' FROM told WHERE m = 2 "
        "UNION ALL SELECT source_md, chunk_index, info_pair_index, 0, q, conclusion, premise || ' | ' || intermediate, 2, "
        "premise || ' | ' || intermediate || ' | third', 3, 'plain' FROM told WHERE m = 4)"
    )


def multihop_sql(ctx: str, num_q: int) -> str:
    return (
        f"{hops_sql(ctx)}, firsts AS (SELECT *, row_number() OVER (PARTITION BY source_md, chunk_index, lower({strip('question')}) "
        "ORDER BY info_pair_index, j) AS dup FROM found), "
        "hops AS (SELECT *, round(least(n_steps / 3.0, 1) * 0.4 + least(n_facts / 3.0, 1) * 0.3 + least(len(regexp_split_to_array(question, ' ')) / 20.0, 1) * 0.15 "
        "+ least(len(list_filter(regexp_split_to_array(answer, '[\\s\\x{a0}\\x{2028}]+'), lambda w: w <> '')) / 50.0, 1) * 0.15, 6)::DOUBLE AS complexity "
        "FROM (SELECT *, row_number() OVER (PARTITION BY source_md, chunk_index ORDER BY info_pair_index, j) AS rn FROM firsts WHERE dup = 1) "
        f"WHERE rn <= {num_q})"
    )


_HOP_OUT = "source_md, chunk_index, info_pair_index, question, answer, steps, facts, qa_type"


@check(
    "multihop_extract",
    "Q16 Q17 Q18 F11 W3",
    f"WITH {chunks_sql(256)}, {contexts_sql('chunks')}, {hops_sql('ctx')} SELECT source_md, chunk_index, info_pair_index, j::BIGINT AS j, "
    "question, answer, steps, facts, qa_type FROM found",
)
def multihop_extract(spark, sf):
    contexts = MultiHopContexts("en")(WordChunks(256)(documents(spark, sf)))
    read = with_multihop_pairs(model("multihop").ask(contexts, "multihop", F.col("context")), True, "pairs")
    each = read.select("source_md", "chunk_index", "info_pair_index", F.posexplode(F.array_compact("pairs")).alias("j", "p"))
    return bigs(
        each.select(
            "source_md", "chunk_index", "info_pair_index", "j", "p.question", "p.answer",
            steps_text("p.reasoning_steps").alias("steps"), text_list("p.supporting_facts").alias("facts"),
            F.col("p.type").alias("qa_type"),
        )
    )


@check(
    "multihop_qa",
    "Q15 A2 W2 P20",
    f"WITH {chunks_sql(256)}, {contexts_sql('chunks')}, {multihop_sql('ctx', 3)} SELECT {_HOP_OUT}, complexity, 'multihop' AS hop_type FROM hops",
)
def multihop_qa(spark, sf):
    contexts = MultiHopContexts("en")(WordChunks(256)(documents(spark, sf)))
    rows = MultiHopQA(model("multihop"), "en", num_q=3)(contexts)
    return bigs(
        rows.select(
            *SHOWN, "info_pair_index", steps_text().alias("steps"), text_list("supporting_facts").alias("facts"), "qa_type",
            "complexity", "hop_type",
        )
    )


# --- depth and width ----------------------------------------------------------------------------------


def subject_pairs(spark, sf):
    """Conversation pairs with an identifier on about half of them."""
    rows = conversation_pairs(spark, sf)
    named = F.when(F.length("question") % 2 == 0, F.concat(F.lit("topic "), F.length("question")))
    return rows.withColumn("identifier", named)


SUBJECT_SQL = (
    f"{PAIRS_SQL}, subj AS (SELECT *, CASE WHEN length(question) % 2 = 0 THEN 'topic ' || length(question) ELSE 'subject ' || length(answer) END AS identifier FROM qa)"
)


def _round_sql(source: str, subject: str, to: str) -> str:
    new = f"({subject} || '+')"
    return (
        f"{to} AS (SELECT *, {new} AS {to}_id FROM {source} WHERE length({subject}) % 6 <> 0 AND (length(question) + length({new})) % 5 <> 0 "
        f"AND (length(answer) + length({new})) % 7 <> 0 AND (length(question) + length(answer) + length({new})) % 4 <> 3)"
    )


DEPTH_SQL = f"{SUBJECT_SQL}, {_round_sql('subj', 'identifier', 'r1')}, {_round_sql('r1', 'r1_id', 'r2')}"
_DEPTH_OUT = (
    "SELECT source_md, chunk_index, 'What is part of ' || {r}_id || '?' AS question, identifier AS answer, {k}::BIGINT AS depth_round, "
    "{r}_id AS new_identifier, 'part of' AS relation, 'no idea ' || length(question) AS llm_answer, 0::BIGINT AS recall_score, 'depth' AS qa_type FROM r2"
)


def _depth_rows(rows):
    return bigs(rows.select(*SHOWN, "depth_round", "new_identifier", "relation", "llm_answer", "recall_score", "qa_type"))


@check(
    "depth_qa",
    "Q19 J4 U1 F7 F9",
    f"WITH {DEPTH_SQL} {_DEPTH_OUT.format(r='r1', k=1)} UNION ALL {_DEPTH_OUT.format(r='r2', k=2)}",
)
def depth_qa(spark, sf):
    return _depth_rows(DepthQA(model("depth"), 2)(subject_pairs(spark, sf)))


WIDTH_SQL = (
    f"{SUBJECT_SQL}, num AS (SELECT *, row_number() OVER (ORDER BY source_md, chunk_index) - 1 AS idx FROM subj), "
    "adj AS (SELECT a.idx AS merge_index, a.idx AS li, b.idx AS ri, a.question AS lq, b.question AS rq, a.answer AS la, b.answer AS ra, "
    "a.identifier AS lid, b.identifier AS rid, a.source_md AS ls, b.source_md AS rs, a.chunk_index AS lc, b.chunk_index AS rc "
    "FROM num a JOIN num b ON b.idx = a.idx + 1), "
    "merged AS (SELECT *, lq || ' / ' || rq AS mq, length(lq) % 4 AS m FROM adj WHERE length(lq) % 13 <> 5 AND length(lq) % 4 <> 2), "
    "origin AS (SELECT *, CASE WHEN length(mq) % 3 = 1 THEN 'Both: ' || mq ELSE mq END AS task, "
    f"CASE m WHEN 0 THEN {strip('la')} || '；' || {strip('ra')} WHEN 1 THEN {strip('ra')} || '；' || {strip('la')} ELSE {strip('la')} END AS golden "
    "FROM merged WHERE length(mq) % 3 <> 0), "
    "width AS (SELECT *, CASE m WHEN 1 THEN rs ELSE ls END AS source_md, CASE m WHEN 1 THEN rc ELSE lc END AS chunk_index, "
    "CASE m WHEN 0 THEN li || ',' || ri WHEN 1 THEN ri || ',' || li ELSE li || '' END AS idxs, "
    "CASE m WHEN 0 THEN lq || ' | ' || rq WHEN 1 THEN rq || ' | ' || lq ELSE lq END AS oq, "
    "CASE m WHEN 0 THEN la || ' | ' || ra WHEN 1 THEN ra || ' | ' || la ELSE la END AS oa, CASE m WHEN 3 THEN 1 ELSE 2 END AS n_sources "
    "FROM origin WHERE length(task) % 5 <> 4 AND length(golden) % 3 <> 2)"
)
_WIDTH_OUT = (
    "SELECT source_md, chunk_index, task AS question, golden AS answer, rid AS content_identifier, idxs AS source_question_indices, "
    "oq AS original_question, oa AS original_answer, n_sources::BIGINT AS n_sources, 'width' AS qa_type FROM width"
)


def _width_rows(rows):
    return bigs(
        rows.select(
            *SHOWN, "content_identifier", F.array_join(F.col("source_question_indices").cast("array<string>"), ",").alias("source_question_indices"),
            text_list("original_question").alias("original_question"), text_list("original_answer").alias("original_answer"),
            F.size("source_rows").alias("n_sources"), "qa_type",
        )
    )


@check("width_qa", "Q20 J5 J6 W4 F10 A7", f"WITH {WIDTH_SQL} {_WIDTH_OUT}")
def width_qa(spark, sf):
    return _width_rows(WidthQA(model("width"))(subject_pairs(spark, sf)))


@check(
    "width_unresolved",
    "J6",
    f"WITH {WIDTH_SQL} SELECT length(lq) % 13 <> 5 AS complete, count(*) AS n FROM adj WHERE length(lq) % 13 = 5 OR length(lq) % 4 <> 2 GROUP BY 1",
)
def width_unresolved(spark, sf):
    width = WidthQA(model("width"))
    return width.resolved(width.indexed(subject_pairs(spark, sf))).groupBy("complete").agg(F.count(F.lit(1)).alias("n"))


# --- the other two generators ---------------------------------------------------------------------------


@check(
    "stored_responses",
    "S11 G2 J1",
    "WITH u AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply FROM conversations u LEFT JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'), "
    "best AS (SELECT question, min_by(reply, conv_id * 1000 + turn) AS reply FROM u WHERE reply IS NOT NULL GROUP BY question) "
    "SELECT u.conv_id, u.turn, u.question, coalesce(b.reply, '') AS response FROM u LEFT JOIN best b USING (question)",
)
def stored_responses(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    prompt = P.CLOSED_BOOK.render(question=F.col("question"))
    stored = asked.join(reply, ["conv_id", "turn"]).select(
        F.lit("chat").alias("stage"), prompt_hash(prompt).alias("prompt_hash"), "response",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("resp_ord"),
    )
    return TableGenerator(stored).ask(asked, "chat", prompt)


def _echo_call():
    """A stand-in model call: prompts with a parenthesis time out. Nested, so that workers get it by value."""

    def call(prompts: list[str], system: str) -> list[str]:
        if "(" in prompts[0]:
            raise TimeoutError("no answer")
        return [p[::-1] for p in prompts]

    return call


@check(
    "called_responses",
    "G0",
    "SELECT conv_id, turn, CASE WHEN contains(text, '(') THEN '' ELSE reverse(text) END AS response, "
    "CASE WHEN contains(text, '(') THEN 'failed' ELSE 'ok' END AS gen_status, "
    "CASE WHEN contains(text, '(') THEN 'no answer' END AS gen_error FROM conversations WHERE role = 'user'",
)
def called_responses(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    asked = CallableGenerator(_echo_call(), partitions=8, threads=2).ask(users, "echo", F.col("text"))
    return asked.select("conv_id", "turn", "response", "gen_status", "gen_error")


# --- prompt projections ---------------------------------------------------------------------------------


def prompt_sql(template: P.Template, **values: str) -> str:
    """The template as a SQL concatenation."""
    import re

    out = []
    for i, piece in enumerate(re.split(r"<<(\w+)>>", template.text)):
        out.append(("'" + piece.replace("'", "''") + "'") if i % 2 == 0 else f"coalesce({values[piece]}, '')")
    return " || ".join(out)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_checks() -> None:
    from qaspark.operators.language import language_instruction

    lang = language_instruction("en")
    doc = {"chunk": "text", "text": "text", "context": "text"}
    on_documents = {
        "singlehop": [
            (P.META_PROMPT, {"amount": P.meta_amount(3), **doc}),
            (P.SEED_PROMPT, {"instruction": "Ask about it", **doc}),
        ],
        "atomic": [
            (P.IDENTIFIER, doc),
            (P.CONCLUSIONS, doc),
            (P.ATOMIC_QUESTION, {"identifier": "@source", "conclusion": "@text", "relation": "@lang"}),
            (P.ATOMIC_CLEAN, {"item": "@text"}),
            (P.CLOSED_BOOK, {"question": "@text"}),
            (P.RECALL, {"golden": "@text", "other": "@source"}),
            (P.ALTERNATIVES, {"answer": "@text"}),
            (P.OPEN_BOOK, {"text": "@text", "question": "@source"}),
        ],
        "depth": [
            (P.SUPERSET, {"identifier": "@text"}),
            (P.SUPERSET_CHECK, {"superset": "@source", "relation": "@lang", "identifier": "@text"}),
            (P.DEPTH_QUESTION, {"superset": "@source", "relation": "@lang", "identifier": "@text"}),
            (P.DEPTH_ANSWER, {"question": "@text"}),
        ],
        "width": [
            (P.WIDTH_MERGE, {"items": "@text"}),
            (P.WIDTH_ORIGIN, {"item": "@text"}),
            (P.WIDTH_ANSWER, {"item": "@text"}),
        ],
        "multihop": [(P.MULTIHOP["en"], doc), (P.MULTIHOP["zh"], doc)],
        "taxonomy": [
            (P.TAXONOMY_TAGS, {"topic": "Texts", "language": lang, "catalog": catalog_text(TAXONOMY), **doc}),
            (
                P.TAXONOMY_QUESTION,
                {
                    "topic": "Texts", "language": lang, "level1": "Form", "level2": "Short", "focus": "f", "hint": "h", "task": "fact",
                    "task_text": "states", "style": "direct", "style_text": "none", **doc,
                },
            ),
            (
                P.TAXONOMY_ANSWER,
                {
                    "topic": "Texts", "language": lang, "level1": "Form", "level2": "Short", "task": "fact", "style": "direct",
                    "question": "@source", **doc,
                },
            ),
        ],
        "edits": [
            (P.EXPAND, {"language": lang, "mode": "detail", "hint": P.EXPANSION_HINTS["detail"], "question": "@source", "answer": "@lang", **doc}),
            (P.THINK, {"language": lang, "question": "@source", "answer": "@lang", **doc}),
            *[(P.SCORE, {"task": t, "language": lang, "question": "@source", "answer": "@lang", **doc}) for t in P.SCORE_TASKS.values()],
        ],
    }
    covers = {
        "singlehop": "P1 P2", "atomic": "P3 P4 P5 P6 P7 P8 P9 P10", "depth": "P11 P12 P13 P14 P15 P16", "width": "P17 P18 P19",
        "multihop": "P20", "taxonomy": "P21 P22 P23 Q14", "edits": "P24 P25 P26",
    }

    def is_column(value: str) -> bool:
        return value in ("text",) or value.startswith("@")

    for group, templates in on_documents.items():
        sql = ", ".join(
            "md5("
            + prompt_sql(t, **{k: v.lstrip("@") if is_column(v) else literal(v) for k, v in values.items()})
            + f") AS p{i}"
            for i, (t, values) in enumerate(templates)
        )

        def run(spark, sf, templates=templates):
            columns = [
                F.md5(t.render(**{k: F.col(v.lstrip("@")) if is_column(v) else v for k, v in values.items()})).alias(f"p{i}")
                for i, (t, values) in enumerate(templates)
            ]
            return table(spark, sf, "documents").select("doc_id", *columns)

        check(f"prompts_{group}", covers[group], f"SELECT doc_id, {sql} FROM documents")(run)


_prompt_checks()


# --- whole flows ----------------------------------------------------------------------------------------

_FILTER = " AND ".join(f"{g} >= 1" for g in GRADES)
_ALPACA = "Please answer the following question based on the provided information."
N1_SQL = (
    f"{SINGLE_SQL}, {scores_sql('single')}, kept AS (SELECT * FROM scored WHERE {_FILTER})"
)


@check(
    "markdown_qa",
    "N1 F2 F3 E1 S4",
    f"WITH {N1_SQL} SELECT '{_ALPACA}' AS instruction, question AS input, answer AS output, source_md, chunk_index FROM kept",
)
def markdown_qa(spark, sf):
    stages = flows.markdown_qa(
        documents(spark, sf), model("singlehop", "scores"), question_num=2, grades=GradeFilter.all_at(1), language="en"
    )
    return bigs(stages["qa_export"])


@check(
    "markdown_qa_edited",
    "N1 Q21 Q22 E1",
    f"WITH {N1_SQL}, {expand_sql('kept', 'contextual')}, {think_sql('expanded')} SELECT '{_ALPACA}' AS instruction, "
    "coalesce(nullif(expanded_question, ''), question) AS input, coalesce(nullif(expanded_answer, ''), answer) AS output, source_md, "
    "chunk_index, think FROM thought",
)
def markdown_qa_edited(spark, sf):
    stages = flows.markdown_qa(
        documents(spark, sf), model("singlehop", "scores", "edits"), question_num=2, grades=GradeFilter.all_at(1), language="en",
        expand="contextual", think=True,
    )
    return bigs(stages["qa_export"])


@check(
    "markdown_qa_atomic",
    "N1 Q4 E1",
    f"WITH {ATOMIC_SQL} SELECT '{_ALPACA}' AS instruction, question AS input, refined AS output, source_md, chunk_index FROM shaped",
)
def markdown_qa_atomic(spark, sf):
    stages = flows.markdown_qa(
        documents(spark, sf), model("atomic"), kind="atomic", question_num=1, atomic_max_per_task=2, language="en"
    )
    return bigs(stages["qa_export"])


@check(
    "markdown_qa_taxonomy",
    "N1 Q11 Q12 Q13 E1 L1",
    f"WITH {TAXA_SQL}, lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_md, chunk_index ORDER BY i) AS rn FROM ta) "
    f"WHERE rn <= 1), {scores_sql('lim')} SELECT '{_ALPACA}' AS instruction, question AS input, answer AS output, source_md, chunk_index, "
    "level1_name, level2_name, task_type, reasoning_style FROM scored WHERE question_quality_grade >= 3",
)
def markdown_qa_taxonomy(spark, sf):
    stages = flows.markdown_qa(
        documents(spark, sf), model("taxonomy", "scores"), kind="taxonomy", taxonomy=TAXONOMY, question_num=1, language="en"
    )
    return bigs(stages["qa_export"])


MULTIHOP_FLOW_SQL = (
    f"{semantic_sql(1200, 256)}, {contexts_sql('schunks')}, {multihop_sql('ctx', 5)}"
)


@check(
    "markdown_multihop_qa",
    "N2 E2",
    f"WITH RECURSIVE {MULTIHOP_FLOW_SQL} SELECT 'Answer the multi-hop question using the provided supporting facts.' AS instruction, "
    "question AS input, answer AS output, source_md, chunk_index, steps, facts, qa_type AS type, complexity FROM hops",
)
def markdown_multihop_qa(spark, sf):
    stages = flows.markdown_multihop_qa(headed_documents(spark, sf), model("multihop"), chunk_words=300, language="en")
    rows = stages["qa_multihop_export"]
    return bigs(
        rows.select(
            "instruction", "input", "output", "source_md", "chunk_index", steps_text("metadata.reasoning_steps").alias("steps"),
            text_list("metadata.supporting_facts").alias("facts"), F.col("metadata.type").alias("type"),
            F.col("metadata.complexity").alias("complexity"),
        )
    )


@check(
    "stage_counts",
    "A1",
    f"WITH {N1_SQL} SELECT 'chunks' AS stage, count(*) AS n FROM chunks UNION ALL SELECT 'qa_generated', count(*) FROM single "
    "UNION ALL SELECT 'qa_scored', count(*) FROM scored UNION ALL SELECT 'qa_filtered', count(*) FROM kept "
    "UNION ALL SELECT 'qa_export', count(*) FROM kept",
)
def stage_count_table(spark, sf):
    stages = flows.markdown_qa(
        documents(spark, sf), model("singlehop", "scores"), question_num=2, grades=GradeFilter.all_at(1), language="en", written=True
    )
    return stage_counts(stages)


@check(
    "expand_table",
    "N3 J8 S4",
    f"WITH {SINGLE_SQL}, {expand_sql('single')} SELECT source_md, chunk_index, question, answer, {', '.join(EXPANDED)} FROM expanded",
)
def expand_table(spark, sf):
    chunks = WordChunks()(documents(spark, sf))
    stored = SingleHopQA(model("singlehop"), 2, "en")(chunks).drop("chunk_text", "context")
    return bigs(flows.expand_table(stored, model("edits"), "detail", "en", chunks).select(*SHOWN, *EXPANDED))


@check(
    "think_table",
    "N4 J8",
    f"WITH {SINGLE_SQL}, bare AS (SELECT *, NULL::VARCHAR AS expanded_question, NULL::VARCHAR AS expanded_answer FROM single), "
    f"{think_sql('bare')} SELECT source_md, chunk_index, question, answer, think, think_status, original_answer FROM thought",
)
def think_table(spark, sf):
    chunks = WordChunks()(documents(spark, sf))
    stored = SingleHopQA(model("singlehop"), 2, "en")(chunks).drop("chunk_text", "context")
    done = flows.think_table(stored, model("edits"), "en", chunks)
    return bigs(done.select(*SHOWN, "think", "think_status", "original_answer"))


@check(
    "depth_table",
    "N5",
    f"WITH {DEPTH_SQL} {_DEPTH_OUT.format(r='r1', k=1)} UNION ALL {_DEPTH_OUT.format(r='r2', k=2)}",
)
def depth_table(spark, sf):
    return _depth_rows(flows.depth_table(subject_pairs(spark, sf), model("depth"), 2))


@check("width_table", "N6", f"WITH {WIDTH_SQL} {_WIDTH_OUT}")
def width_table(spark, sf):
    return _width_rows(flows.width_table(subject_pairs(spark, sf), model("width")))


@check(
    "review_session",
    "N7 R1 F4",
    f"WITH {SINGLE_SQL}, {scores_sql('single')} SELECT 'qa-' || (row_number() OVER (ORDER BY source_md, chunk_index, i, j) - 1) AS id, "
    "row_number() OVER (ORDER BY source_md, chunk_index, i, j) - 1 AS sort_index, source_md, chunk_index, question, "
    f"{_FILTER.replace(">= 1", ">= 3")} AS filter_passed, false AS deleted FROM scored",
)
def review_session(spark, sf):
    items = flows.review_session(
        documents(spark, sf), model("singlehop", "scores"), "s1", min_score=3.0, language="en", question_num=2
    )
    return bigs(items.select("id", "sort_index", "source_md", "chunk_index", "question", "filter_passed", "deleted"))


_MADE_SQL = f"{SINGLE_SQL}, subj AS (SELECT source_md, chunk_index, i, j, question, answer, 'subject ' || length(answer) AS identifier FROM single)"


@check(
    "review_session_depth",
    "N7 Q19",
    f"WITH {_MADE_SQL}, {_round_sql('subj', 'identifier', 'r1')}, {_round_sql('r1', 'r1_id', 'r2')} {_DEPTH_OUT.format(r='r1', k=1)} UNION ALL {_DEPTH_OUT.format(r='r2', k=2)}",
)
def review_session_depth(spark, sf):
    """The depth stage of a review job over all documents."""
    stages = flows.review_flow(documents(spark, sf), model("singlehop", "scores", "depth"), "s1", language="en", question_num=2, add_depth=True)
    return _depth_rows(stages["depth"])


@check(
    "review_session_width",
    "N7 Q20",
    "WITH " + WIDTH_SQL.replace(SUBJECT_SQL, _MADE_SQL).replace("ORDER BY source_md, chunk_index)", "ORDER BY source_md, chunk_index, i, j)") + f" {_WIDTH_OUT}",
)
def review_session_width(spark, sf):
    """The width stage of a review job over all documents."""
    stages = flows.review_flow(documents(spark, sf), model("singlehop", "scores", "width"), "s1", language="en", question_num=2, add_width=True)
    return _width_rows(stages["width"])

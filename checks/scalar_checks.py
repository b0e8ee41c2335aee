"""Text, JSON and parsing functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.model import model
from checks.registry import DOCS_SQL, HEADED_SQL, PAIRS_SQL, WS_SQL, bigs, check, conversation_pairs, documents, strip, table, words
from qaspark.functions.text import iso_time, utc_now
from qaspark.functions import jsontext as J, text as X
from qaspark.operators.singlehop import prompt_list, with_pairs
from qaspark.sources.tables import spread

L = F.length
PUNCT_SQL = "[!-/:-@\\[-`{-~]"
# RE2 word borders are ASCII only, so the neighbours are spelled out
ARTICLES_SQL = r"(^|[^\p{L}\p{N}\p{M}_])(a|an|the)($|[^\p{L}\p{N}\p{M}_])"


def norm_sql(x: str) -> str:
    """Answer normalisation in SQL."""
    bare = f"regexp_replace(lower({x}), '{PUNCT_SQL}', '', 'g')"
    # the pattern eats both neighbours, so adjoining articles need a second pass
    once = f"regexp_replace({bare}, '{ARTICLES_SQL}', '\\1 \\3', 'g')"
    no_articles = f"regexp_replace({once}, '{ARTICLES_SQL}', '\\1 \\3', 'g')"
    return f"array_to_string({words(no_articles)}, ' ')"


@check(
    "text_functions",
    "X1 X2 X11",
    f"WITH {DOCS_SQL} SELECT source_md, length({strip('text')}) AS stripped_chars, length(text) AS chars, "
    f"len({words('text')}) AS n_words, array_to_string({words('text')}, ' ') AS collapsed FROM docs",
)
def text_functions(spark, sf):
    t = F.col("text")
    return bigs(
        documents(spark, sf).select(
            "source_md",
            L(X.py_strip(t)).alias("stripped_chars"),
            L(t).alias("chars"),
            X.word_count(t).alias("n_words"),
            F.array_join(X.py_words(t), " ").alias("collapsed"),
        )
    )


@check(
    "special_char_ratio",
    "F6",
    "SELECT doc_id, round(length(regexp_replace(text, '[\\p{L}\\p{N}" + WS_SQL + "]+', '', 'g')) / length(text)::DOUBLE, 6) "
    "AS ratio FROM documents",
)
def special_char_ratio(spark, sf):
    return bigs(table(spark, sf, "documents").select("doc_id", X.special_char_ratio(F.col("text")).alias("ratio")))


@check(
    "content_hash",
    "X12",
    "SELECT doc_id, sha256(text) AS digest, true AS dated FROM documents",
)
def content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.current_timestamp().isNotNull().alias("dated")
    )


@check(
    "iso_times",
    "X13",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || 'Z' AS at, "
    "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || 'Z' AS whole, true AS past FROM events",
)
def iso_times(spark, sf):
    moment = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        "event_id", iso_time(moment).alias("at"), iso_time(F.date_trunc("second", moment).cast("timestamp_ntz")).alias("whole"), (iso_time(moment) < utc_now()).alias("past")
    )


# One row per document and response form; the payload is the whole text of the document.
_FORMS = (
    "forms AS (SELECT doc_id, text, unnest(['bare', 'fenced', 'plain fence', 'chatter', 'tail', 'single', 'list', 'number']) "
    "AS form FROM documents)"
)


def _responses(spark, sf):
    obj = F.to_json(F.struct(F.col("text").alias("content_identifier"), F.col("n_chars").alias("answer_score")))
    forms = {
        "bare": obj,
        "fenced": F.concat(F.lit("```json\n"), obj, F.lit("\n```")),
        "plain fence": F.concat(F.lit(" ```"), obj, F.lit("``` ")),
        "chatter": F.concat(F.lit("Here you are: "), obj),
        "tail": F.concat(obj, F.lit(" done")),
        "single": F.lit("{'content_identifier': 'x'}"),
        "list": F.concat(F.lit("["), obj, F.lit("]")),
        "number": F.lit(" 12 "),
    }
    each = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("response")) for k, v in forms.items()])
    return spread(table(spark, sf, "documents")).select("doc_id", "text", "n_chars", F.inline(each))


@check(
    "json_responses",
    "X3 X4 X5 X6 X7 X15",
    f"WITH {_FORMS} SELECT doc_id, form, form IN ('bare', 'fenced', 'plain fence') AS is_object, "
    "form NOT IN ('single', 'chatter', 'tail') AS is_json, "
    "form IN ('bare', 'fenced', 'plain fence', 'chatter') AS tail_is_object, "
    f"CASE WHEN form IN ('bare', 'fenced', 'plain fence') THEN {strip('text')} END AS identifier, "
    "CASE form WHEN 'single' THEN '{''content_identifier'': ''x''}' WHEN 'number' THEN '12' END AS raw_identifier "
    "FROM forms",
)
def json_responses(spark, sf):
    r = F.col("response")
    read = _responses(spark, sf).select(
        "doc_id", "form", J.is_object(J.json_object(r)).alias("is_object"),
        J.strict_json(J.clean_json_block(r)).isNotNull().alias("is_json"),
        J.json_tail_object(r).isNotNull().alias("tail_is_object"),
        J.content_identifier(r).alias("_id"),
    )
    return read.select(
        "doc_id", "form", "is_object", "is_json", "tail_is_object",
        F.when(F.col("is_object"), F.col("_id")).alias("identifier"),
        F.when(F.col("form").isin("single", "number"), F.col("_id")).alias("raw_identifier"),
    )


@check(
    "superset_fields",
    "X8",
    "SELECT doc_id, CASE WHEN source = 'src0' THEN NULL ELSE lang END AS identifier, "
    "CASE WHEN source = 'src0' THEN NULL ELSE source END AS relation FROM documents",
)
def superset_fields(spark, sf):
    from qaspark.operators.agentic import superset

    relation = F.when(F.col("source") == "src0", F.lit(" ")).otherwise(F.concat(F.lit(" "), "source"))
    asked = table(spark, sf, "documents").select(
        "doc_id", F.to_json(F.struct(F.col("lang").alias("identifier"), relation.alias("relation"))).alias("response")
    )
    fields = superset(J.json_object(F.col("response")))
    read = asked.select("doc_id", fields["new_identifier"].alias("i"), fields["relation"].alias("r"))
    both = (F.col("i") != "") & (F.col("r") != "")
    return read.select("doc_id", F.when(both, F.col("i")).alias("identifier"), F.when(both, F.col("r")).alias("relation"))


@check(
    "recall_scores",
    "X9 F7 F8",
    "WITH s AS (SELECT source_md, chunk_index, length(question) % 7 AS k FROM (SELECT 'conv-' || u.conv_id AS source_md, "
    "u.turn AS chunk_index, u.text AS question FROM conversations u WHERE u.role = 'user')), "
    "v AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS score FROM s) "
    "SELECT source_md, chunk_index, score::BIGINT AS score, coalesce(score < 1, false) AS closed_kept, "
    "coalesce(score >= 1, false) AS open_kept FROM v",
)
def recall_scores(spark, sf):
    from qaspark.operators.atomic import closed_book_failed, open_book_succeeded

    users = table(spark, sf, "conversations").filter("role = 'user'")
    forms = F.array(
        F.lit('{"answer_score": 0}'), F.lit('{"answer_score": "1"}'), F.lit('```json\n{"answer_score": 1.9}\n```'),
        F.lit('{"answer_score": " 2 "}'), F.lit('{"answer_score": true}'), F.lit('{"answer_score": "two"}'), F.lit("{}"),
    )
    scored = users.select(
        F.concat(F.lit("conv-"), "conv_id").alias("source_md"),
        F.col("turn").alias("chunk_index"),
        J.recall_score(F.get(forms, L("text") % 7)).alias("score"),
    )
    return bigs(
        scored.withColumns(
            {"closed_kept": closed_book_failed(F.col("score")), "open_kept": open_book_succeeded(F.col("score"))}
        )
    )


@check(
    "answer_normalization",
    "X10",
    f"SELECT conv_id, turn, {norm_sql('text')} AS normalized FROM conversations",
)
def answer_normalization(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("normalized"))


@check(
    "token_f1",
    "A3",
    f"WITH {PAIRS_SQL}, n AS (SELECT source_md, chunk_index, string_split({norm_sql('answer')}, ' ') AS p, "
    f"[string_split({norm_sql('question')}, ' '), string_split({norm_sql('chunk_text')}, ' ')] AS truths FROM qa), "
    "t AS (SELECT source_md, chunk_index, p, unnest(truths) AS g, unnest(generate_series(1, 2)) AS k FROM n), "
    "tok_p AS (SELECT source_md, chunk_index, k, tok, count(*) AS c FROM (SELECT source_md, chunk_index, k, unnest(p) AS tok "
    "FROM t) GROUP BY ALL), "
    "tok_g AS (SELECT source_md, chunk_index, k, tok, count(*) AS c FROM (SELECT source_md, chunk_index, k, unnest(g) AS tok "
    "FROM t) GROUP BY ALL), "
    "same AS (SELECT source_md, chunk_index, k, sum(least(a.c, b.c)) AS s FROM tok_p a JOIN tok_g b "
    "USING (source_md, chunk_index, k, tok) GROUP BY ALL), "
    "f AS (SELECT t.source_md, t.chunk_index, coalesce(2.0 * (s / len(p)::DOUBLE) * (s / len(g)::DOUBLE) / "
    "((s / len(p)::DOUBLE) + (s / len(g)::DOUBLE)), 0) AS f1 FROM t LEFT JOIN same USING (source_md, chunk_index, k)) "
    "SELECT source_md, chunk_index, round(max(f1), 6)::DOUBLE AS f1 FROM f GROUP BY ALL",
)
def token_f1(spark, sf):
    rows = conversation_pairs(spark, sf)
    f1 = X.token_f1(F.col("answer"), F.array("question", "chunk_text"))
    return bigs(rows.select("source_md", "chunk_index", f1.alias("f1")))


@check(
    "grade_parsing",
    "Q24",
    f"WITH {PAIRS_SQL}, k AS (SELECT source_md, chunk_index, length(question) AS lq, length(answer) AS la, "
    "length(chunk_text) AS n, unnest([0, 1, 2, 3]) AS k FROM qa), "
    "g AS (SELECT *, (lq * (k + 1) + la + n) % 5 + 1 AS g FROM k) "
    "SELECT source_md, chunk_index, k::BIGINT AS k, CASE WHEN (lq + k) % 7 = 0 THEN 0.0 WHEN g = 3 THEN 3.5 ELSE g END::DOUBLE AS grade, "
    "CASE WHEN (lq + k) % 7 = 0 THEN '' ELSE 'seen ' || la || chr(10) || 'end' END AS feedback FROM g",
)
def grade_parsing(spark, sf):
    from checks.model import score_rule

    rows = conversation_pairs(spark, sf)
    each = F.array(*[F.struct(F.lit(k).alias("k"), score_rule(k).alias("response")) for k in range(4)])
    told = rows.select("source_md", "chunk_index", F.inline(each))
    return bigs(
        told.select("source_md", "chunk_index", "k", J.grade(F.col("response")).alias("grade"), J.feedback(F.col("response")).alias("feedback"))
    )


@check(
    "instruction_lists",
    "Q2",
    "WITH d AS (SELECT doc_id, length(text) % 5 AS k FROM documents), p AS (SELECT doc_id, CASE k "
    "WHEN 0 THEN ['Ask who acts', 'Ask what follows'] WHEN 1 THEN ['Ask who acts', 'Ask when'] "
    "WHEN 2 THEN ['Ask where', 'Ask why'] ELSE CAST([] AS VARCHAR[]) END AS ps FROM d) "
    "SELECT doc_id, unnest(generate_series(0, len(ps) - 1)) AS i, unnest(ps) AS instruction FROM p WHERE len(ps) > 0",
)
def instruction_lists(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("text", "chunk_text")
    asked = model("singlehop").ask(docs, "instructions", F.col("chunk_text"))
    return bigs(asked.select("doc_id", F.posexplode(prompt_list(F.col("response"))).alias("i", "instruction")))


@check(
    "pair_responses",
    "Q3",
    "WITH d AS (SELECT doc_id, text, length(text) AS n, unnest(['Ask who acts', 'Ask whom']) AS g FROM documents), "
    "m AS (SELECT *, (n + length(g)) % 4 AS m, g || ' in ' || n || ' characters?' AS q, md5(text) AS a FROM d), "
    "p AS (SELECT *, CASE m WHEN 0 THEN [q, q || ' More?'] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE [q] END AS qs, "
    "CASE m WHEN 0 THEN [a, a || ' more'] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE [a] END AS ans FROM m) "
    "SELECT doc_id, g AS generated_prompt, unnest(generate_series(0, len(qs) - 1)) AS j, unnest(qs) AS question, "
    "unnest(ans) AS answer FROM p WHERE len(qs) > 0",
)
def pair_responses(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("chunk_text"),
        F.explode(F.array(F.lit("Ask who acts"), F.lit("Ask whom"))).alias("generated_prompt"),
    )
    asked = with_pairs(model("singlehop").ask(docs, "pairs", F.col("chunk_text")))
    return bigs(
        asked.select("doc_id", "generated_prompt", F.posexplode(F.array_compact("pairs")).alias("j", "_p")).select(
            "doc_id", "generated_prompt", "j", "_p.*"
        )
    )

"""Chunking and context building over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import DOCS_SQL, HEADED_SQL, WS_SQL, bigs, check, chunks_sql, documents, headed_documents, strip
from qaspark.functions.text import py_strip
from qaspark.operators import chunking as K
from qaspark.operators.contexts import MultiHopContexts, passes_gate, sentences

MAX_CHARS, MIN_CHARS = 600, 80
HEADING_SQL = f"(?m)^(#{{1,6}})[{WS_SQL}]+(.+?)[{WS_SQL}]*$"
GAP_SQL = f"\\n[{WS_SQL}]*\\n"


@check("word_chunks", "C1 S1", f"WITH {chunks_sql()} SELECT * FROM chunks")
def word_chunks(spark, sf):
    return bigs(K.WordChunks()(documents(spark, sf)))


@check("word_chunks_overlap", "C1", f"WITH {chunks_sql(64, 16)} SELECT * FROM chunks")
def word_chunks_overlap(spark, sf):
    return bigs(K.WordChunks(64, 16)(documents(spark, sf)))


# sections: level, title and body of every heading, with the preamble as level 0
SECTIONS_SQL = (
    f"{HEADED_SQL}, cut_up AS (SELECT source_md, text, regexp_split_to_array(text, '{HEADING_SQL}') AS bodies, "
    f"regexp_extract_all(text, '{HEADING_SQL}', 1) AS marks, regexp_extract_all(text, '{HEADING_SQL}', 2) AS titles FROM headed), "
    "each_part AS (SELECT source_md, text, len(marks) AS n, unnest(generate_series(0, len(marks))) AS k, unnest(bodies) AS body, "
    "unnest(list_concat([''], marks)) AS mark, unnest(list_concat([''], titles)) AS title FROM cut_up), "
    f"parts AS (SELECT source_md, k, length(mark) AS level, {strip('title')} AS title, {strip('body')} AS body FROM each_part "
    f"WHERE n > 0 AND (k > 0 OR {strip('body')} <> '')), "
    "sections AS (SELECT source_md, row_number() OVER (PARTITION BY source_md ORDER BY k) - 1 AS pos, level, title, body FROM parts "
    "UNION ALL SELECT source_md, 0, 0, '', text FROM each_part WHERE n = 0)"
)


@check("markdown_sections", "C3", f"WITH {SECTIONS_SQL} SELECT source_md, pos, level, title, body FROM sections")
def markdown_sections(spark, sf):
    cut = headed_documents(spark, sf).select("source_md", F.posexplode(K.sections(F.col("text"))).alias("pos", "s"))
    return bigs(cut.select("source_md", "pos", "s.*"))


@check(
    "paragraphs",
    "C5",
    f"WITH {HEADED_SQL}, p AS (SELECT source_md, list_filter(list_transform(regexp_split_to_array({strip('text')}, '{GAP_SQL}'), "
    f"lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM headed) "
    "SELECT source_md, unnest(generate_series(0, len(ps) - 1)) AS pos, unnest(ps) AS paragraph FROM p",
)
def paragraphs(spark, sf):
    split = headed_documents(spark, sf).select("source_md", F.posexplode(K.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return bigs(split)


# Packing units of a section body, then a recursive walk over them that opens and closes groups.
_SENTENCES_SQL = (
    f"list_filter(list_transform(string_split(regexp_replace(par, '([。！？.!?])[{WS_SQL}]*', '\\1' || chr(57344), 'g'), chr(57344)), "
    f"lambda x: {strip('x')}), lambda x: x <> '')"
)


def packing_sql(source: str, max_chars: int) -> str:
    """CTEs from ``source(doc, pos, level, title, body)`` to ``groups(doc, pos, level, title, g, part)``."""
    return (
        f"pars AS (SELECT doc, pos, unnest(generate_series(0, len(ps) - 1)) AS i, unnest(ps) AS par FROM (SELECT doc, pos, "
        f"list_filter(list_transform(regexp_split_to_array({strip('body')}, '{GAP_SQL}'), lambda x: {strip('x')}), lambda x: x <> '') "
        f"AS ps FROM {source} WHERE length(body) > {max_chars})), "
        f"pieces AS (SELECT doc, pos, i, par, length(par) > {max_chars} AS over, {_SENTENCES_SQL} AS ss FROM pars), "
        "units0 AS (SELECT doc, pos, i, 0 AS j, par AS u, -1 AS run, 2 AS joint FROM pieces WHERE NOT over "
        "UNION ALL SELECT doc, pos, i, unnest(generate_series(0, len(ss) - 1)), unnest(ss), i, 1 FROM pieces WHERE over), "
        "units AS (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY i, j) AS k, length(u) AS size FROM units0), "
        "walk AS (SELECT doc, pos, k, run, size AS used, 0 AS g FROM units WHERE k = 1 UNION ALL "
        "SELECT u.doc, u.pos, u.k, u.run, "
        f"CASE WHEN u.run <> w.run OR w.used + u.joint + u.size > {max_chars} THEN u.size ELSE w.used + u.joint + u.size END, "
        f"CASE WHEN u.run <> w.run OR w.used + u.joint + u.size > {max_chars} THEN w.g + 1 ELSE w.g END "
        "FROM walk w JOIN units u ON u.doc = w.doc AND u.pos = w.pos AND u.k = w.k + 1), "
        "packed AS (SELECT w.doc, w.pos, w.g, CASE WHEN max(u.joint) = 2 THEN string_agg(u.u, chr(10) || chr(10) ORDER BY u.k) ELSE string_agg(u.u, '' ORDER BY u.k) END AS part FROM walk w JOIN units u "
        "USING (doc, pos, k) GROUP BY w.doc, w.pos, w.g), "
        f"groups AS (SELECT s.doc, s.pos, s.level, s.title, p.g, p.part FROM {source} s JOIN packed p USING (doc, pos) "
        f"UNION ALL SELECT doc, pos, level, title, 0, {strip('body')} FROM {source} WHERE length(body) <= {max_chars} AND {strip('body')} <> '')"
    )


@check(
    "paragraph_groups",
    "C4 C6",
    f"WITH RECURSIVE {HEADED_SQL}, src AS (SELECT source_md AS doc, 0 AS pos, 0 AS level, '' AS title, text AS body FROM headed), "
    f"{packing_sql('src', 300)} SELECT doc AS source_md, g::BIGINT AS pos, part FROM groups",
)
def paragraph_groups(spark, sf):
    docs = headed_documents(spark, sf)
    return bigs(docs.select("source_md", F.posexplode(K.paragraph_groups(F.col("text"), 300)).alias("pos", "part")))


_PREFIX_SQL = (
    "CASE WHEN title = '' THEN '' ELSE (CASE WHEN level > 0 THEN repeat('#', level) ELSE '##' END) || ' ' || title || chr(10) || chr(10) END"
)


def semantic_sql(max_chars: int, min_chars: int) -> str:
    """CTEs ending in ``schunks(source_md, chunk_index, chunk_text, section_title, section_level)``."""
    return (
        f"{SECTIONS_SQL}, src AS (SELECT source_md AS doc, pos, level, title, body FROM sections WHERE {strip('body')} <> ''), "
        f"{packing_sql('src', max_chars)}, "
        f"prefixed AS (SELECT doc, pos, g, level, title, {strip('(' + _PREFIX_SQL + ' || part)')} AS chunk_text FROM groups), "
        "schunks AS (SELECT doc AS source_md, row_number() OVER (PARTITION BY doc ORDER BY pos, g) - 1 AS chunk_index, chunk_text, "
        f"title AS section_title, level AS section_level FROM prefixed WHERE length(chunk_text) >= {min_chars})"
    )


@check(
    "semantic_chunks",
    "C2 C7",
    f"WITH RECURSIVE {semantic_sql(MAX_CHARS, MIN_CHARS)} SELECT *, 'semantic' AS chunking_strategy FROM schunks",
)
def semantic_chunks(spark, sf):
    return bigs(K.SemanticChunks(MAX_CHARS, MIN_CHARS)(headed_documents(spark, sf)))


GATE_SQL = (
    "length(t) BETWEEN 100 AND 200000 AND (length(t) - length(replace(t, '。', '')) >= 2 OR length(t) - length(replace(t, '.', '')) >= 2) "
    f"AND length(regexp_replace(t, '[\\p{{L}}\\p{{N}}{WS_SQL}]+', '', 'g')) / length(t)::DOUBLE <= 0.3"
)


@check("context_gate", "F5", f"WITH s AS (SELECT doc_id, {strip('text')} AS t FROM documents) SELECT 'doc-' || doc_id AS source_md, {GATE_SQL} AS passes FROM s")
def context_gate(spark, sf):
    return documents(spark, sf).select("source_md", passes_gate(py_strip(F.col("text"))).alias("passes"))


def sentences_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '.'), lambda x: {strip('x')}), lambda x: length(x) > 2)"


@check(
    "sentences",
    "C9",
    f"WITH {DOCS_SQL}, s AS (SELECT source_md, {sentences_sql('text')} AS ss FROM docs) "
    "SELECT source_md, unnest(generate_series(0, len(ss) - 1)) AS pos, unnest(ss) AS sentence FROM s WHERE len(ss) > 0",
)
def sentence_split(spark, sf):
    return bigs(documents(spark, sf).select("source_md", F.posexplode(sentences(F.col("text"), "en")).alias("pos", "sentence")))


def contexts_sql(chunks: str) -> str:
    """CTEs from ``chunks(source_md, chunk_index, chunk_text)`` to ``ctx``."""
    return (
        f"gated AS (SELECT source_md, chunk_index, {strip('chunk_text')} AS t FROM {chunks}), "
        f"sents AS (SELECT source_md, chunk_index, {sentences_sql('t')} AS ss FROM gated WHERE {GATE_SQL}), "
        "slots AS (SELECT source_md, chunk_index, ss, unnest(generate_series(1, len(ss) - 2)) AS i FROM sents WHERE len(ss) >= 3), "
        "longs AS (SELECT source_md, chunk_index, i, ss, list_slice(list_filter(list_transform(ss, lambda x, p: {'p': p, 's': x}), "
        "lambda e: length(e.s) > 10), 1, 4) AS ls FROM slots), "
        "ctx AS (SELECT source_md, chunk_index, row_number() OVER (PARTITION BY source_md, chunk_index ORDER BY i) - 1 AS info_pair_index, "
        "ss[i] AS premise, ss[i + 1] AS intermediate, ss[i + 2] AS conclusion, "
        "list_transform(list_slice(list_filter(ls, lambda e: e.p <> i AND e.p <> i + 1), 1, 2), lambda e: e.s) AS related, "
        "ss[i] || '. ' || ss[i + 1] || '. ' || ss[i + 2] AS context FROM longs WHERE length(ss[i]) > 10 AND length(ss[i + 1]) > 10)"
    )


@check(
    "multihop_contexts",
    "C8 C10 C11 W1",
    f"WITH {chunks_sql(256)}, {contexts_sql('chunks')} SELECT source_md, chunk_index, info_pair_index, premise, intermediate, conclusion, "
    "array_to_string(related, ' | ') AS related, context, 3::BIGINT AS supporting_sentence_count FROM ctx",
)
def multihop_contexts(spark, sf):
    contexts = MultiHopContexts("en")(K.WordChunks(256)(documents(spark, sf)))
    return bigs(
        contexts.select(
            "source_md", "chunk_index", "info_pair_index", "premise", "intermediate", "conclusion",
            F.array_join("related_contexts", " | ").alias("related"), "context", "supporting_sentence_count",
        )
    )

"""Variety, term lists, repeated texts and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import PAIRS_SQL, bigs, check, conversation_pairs, table
from qaspark.operators import selection as S

_WORDS_SQL = "regexp_split_to_array(regexp_replace(lower(question), '^\\s+|\\s+$', '', 'g'), '\\s+')"


@check(
    "diverse_pairs",
    "K2",
    f"WITH {PAIRS_SQL}, k AS (SELECT *, array_to_string(list_slice({_WORDS_SQL}, 1, 1), ' ') AS kind FROM qa) "
    "SELECT source_md, chunk_index::BIGINT AS chunk_index, question FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY source_md, chunk_index) AS rn FROM k) WHERE rn <= 2",
)
def diverse_pairs(spark, sf):
    pairs = conversation_pairs(spark, sf)
    kept = S.diverse(pairs, [S.opening(F.col("question"), 1)], ["source_md", "chunk_index"], 2)
    return bigs(kept.select("source_md", "chunk_index", "question"))


@check(
    "first_of_text",
    "K1",
    "SELECT min(doc_id) AS doc_id, count(*) AS same FROM (SELECT doc_id, lower(text) AS t FROM documents) GROUP BY t",
)
def first_of_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = S.first_of_text(docs, ["text"], ["doc_id"]).select("doc_id", F.lower("text").alias("t"))
    sizes = docs.groupBy(F.lower("text").alias("t")).agg(F.count(F.lit(1)).alias("same"))
    return first.join(sizes, "t").select("doc_id", "same")


@check(
    "pair_documents",
    "K3",
    f"WITH {PAIRS_SQL} SELECT source_md, array_to_string(list(question || ' = ' || answer ORDER BY chunk_index), ' | ') AS pairs FROM qa GROUP BY source_md",
)
def pair_documents(spark, sf):
    pairs = conversation_pairs(spark, sf).withColumn("turn", F.col("chunk_index")).withColumn("chunk_index", F.lit(0))
    nested = S.pair_documents(pairs, ["turn"])
    text = F.array_join(F.transform("pairs", lambda p: F.concat(p["question"], F.lit(" = "), p["answer"])), " | ")
    return nested.select("source_md", text.alias("pairs"))


_TERMS = ("the", "der", "que", "éau", "idiot")
_TERMS_SQL = ", ".join(f"'{t}'" for t in _TERMS)


@check(
    "term_counts",
    "K4",
    "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: list_contains([" + _TERMS_SQL + "], w))) AS hits FROM documents",
)
def term_counts(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term")).distinct()
    return bigs(S.term_counts(table(spark, sf, "documents").select("doc_id", "text"), terms, ["doc_id"]))


@check(
    "without_terms",
    "K4",
    "SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: list_contains([" + _TERMS_SQL + "], w))) <= 3",
)
def without_terms(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term")).distinct()
    return S.without_terms(table(spark, sf, "documents").select("doc_id", "text"), terms, ["doc_id"], 3).select("doc_id")

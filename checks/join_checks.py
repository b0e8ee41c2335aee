"""Joins and order-based operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import DOCS_SQL, PAIRS_SQL, bigs, check, chunks_sql, conversation_pairs, documents, table
from checks.table_checks import LINES_SQL, lines
from qaspark.operators.agentic import adjacent_pairs, fill_identifiers, gather
from qaspark.operators.chunking import WordChunks
from qaspark.operators.generation import ExpressionGenerator
from qaspark.operators.ordering import dense_index, dense_index_in_group, next_in_group
from qaspark.operators.review import item_links
from qaspark.plans.qa import reattach_context

_NUMBERED = f"{DOCS_SQL}, num AS (SELECT source_md, text, row_number() OVER (ORDER BY source_md) - 1 AS idx FROM docs)"


@check("dense_index", "J5 R1", f"WITH {LINES_SQL} SELECT source_md, line_no, row_number() OVER (ORDER BY source_md, line_no) - 1 AS idx FROM lines")
def dense(spark, sf):
    return bigs(dense_index(lines(spark, sf), ["source_md", "line_no"]).select("source_md", "line_no", "idx"))


@check(
    "dense_index_in_group",
    "R1",
    f"WITH {LINES_SQL} SELECT source_md, line_no, row_number() OVER (PARTITION BY length(line) % 3 = 0 ORDER BY source_md, line_no) - 1 AS idx FROM lines",
)
def dense_in_group(spark, sf):
    rows = lines(spark, sf).withColumn("grp", F.length("line") % 3 == 0)
    return bigs(dense_index_in_group(rows, ["grp"], ["source_md", "line_no"]).select("source_md", "line_no", "idx"))


@check(
    "next_in_group",
    "W4",
    f"WITH {LINES_SQL} SELECT source_md, line_no, lead(line) OVER (PARTITION BY length(line) % 3 = 0 ORDER BY source_md, line_no) AS next_line FROM lines",
)
def next_line(spark, sf):
    rows = lines(spark, sf).withColumn("grp", F.length("line") % 3 == 0)
    return bigs(next_in_group(rows, ["grp"], ["source_md", "line_no"], "line", "next_line").select("source_md", "line_no", "next_line"))


@check(
    "adjacent_pairs",
    "J5 W4",
    f"WITH {_NUMBERED} SELECT a.idx AS merge_index, a.source_md AS l, b.source_md AS r FROM num a JOIN num b ON b.idx = a.idx + 1",
)
def adjacent(spark, sf):
    pairs = adjacent_pairs(dense_index(documents(spark, sf), ["source_md"]), ["source_md"])
    return bigs(pairs.select("merge_index", F.col("left.source_md").alias("l"), F.col("right.source_md").alias("r")))


@check(
    "index_gather",
    "J6 A7",
    f"WITH {_NUMBERED}, want AS (SELECT idx AS merge_index, unnest([idx + 1, 0, idx - 1]) AS idx, unnest([0, 1, 2]) AS k FROM num) "
    "SELECT merge_index, count(*) AS wanted, string_agg(source_md, ' | ' ORDER BY k) AS sources FROM want LEFT JOIN num USING (idx) GROUP BY merge_index",
)
def index_gather(spark, sf):
    """Every row also asks for row 0, so one key meets a third of all requests."""
    indexed = dense_index(documents(spark, sf).select("source_md"), ["source_md"])
    links = indexed.select(
        F.col("idx").alias("merge_index"), F.array(F.col("idx") + 1, F.lit(0).cast("bigint"), F.col("idx") - 1).alias("indices")
    )
    found = gather(links, indexed, ["source_md"])
    return bigs(
        found.select("merge_index", "wanted", F.array_join(F.transform("sources", lambda s: s.source_md), " | ").alias("sources"))
    )


@check(
    "identifier_fill",
    "J4",
    f"WITH {PAIRS_SQL} SELECT source_md, chunk_index, CASE WHEN length(question) % 2 = 0 THEN 'known' ELSE 'from ' || length(question) END AS identifier FROM qa",
)
def identifier_fill(spark, sf):
    rows = conversation_pairs(spark, sf).withColumn(
        "identifier", F.when(F.length("question") % 2 == 0, F.lit("known")).otherwise(F.lit("  "))
    )
    rule = F.concat(F.lit("from "), F.length("question"))
    return bigs(fill_identifiers(rows, ExpressionGenerator({"identifier": rule})).select("source_md", "chunk_index", "identifier"))


@check(
    "context_reattach",
    "J8",
    f"WITH {chunks_sql(64)}, qa AS (SELECT source_md, chunk_index, unnest([1, 2]) AS k FROM chunks) "
    "SELECT source_md, chunk_index, k::BIGINT AS k, chunk_text, chunk_text AS context FROM qa LEFT JOIN chunks USING (source_md, chunk_index)",
)
def context_reattach(spark, sf):
    chunks = WordChunks(64)(documents(spark, sf))
    qa = chunks.select("source_md", "chunk_index", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return bigs(reattach_context(qa, chunks))


@check(
    "job_session_links",
    "J7",
    "WITH s AS (SELECT DISTINCT 'conv-' || conv_id AS session_id, 'job-' || (conv_id // 5) AS job_id FROM conversations) "
    "SELECT u.source AS upload_id, j.job_id, s.session_id, c.turn AS item FROM (SELECT 'job-' || doc_id AS job_id, source FROM documents) j "
    "JOIN (SELECT DISTINCT source FROM documents) u USING (source) JOIN s USING (job_id) JOIN conversations c ON 'conv-' || c.conv_id = s.session_id",
)
def job_session_links(spark, sf):
    docs, turns = table(spark, sf, "documents"), table(spark, sf, "conversations")
    uploads = docs.select(F.col("source").alias("upload_id")).distinct()
    jobs = docs.select(F.concat(F.lit("job-"), "doc_id").alias("job_id"), F.col("source").alias("upload_id"))
    sessions = turns.select(
        F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.concat(F.lit("job-"), F.expr("conv_id div 5")).alias("job_id")
    ).distinct()
    items = turns.select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("turn").alias("item"))
    return item_links(uploads, jobs, sessions, items).select("upload_id", "job_id", "session_id", "item")

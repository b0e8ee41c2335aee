"""Stored layouts: deep pages, sharded items, posting lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.registry import bigs, check, table
from qaspark.operators.pages import PhraseIndex, ShardedItems, StoredPages
from qaspark.session import new_table_path

_PAGE = ["l_orderkey", "l_linenumber", "l_partkey"]


@check("deep_record_page", "O4", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 30 OFFSET 50000")
def deep_record_page(spark, sf):
    pages = StoredPages.write(table(spark, sf, "lineitem").select(*_PAGE), new_table_path(spark, "pages"), _PAGE, rows_per_part=5000)
    return bigs(pages.page(30, 50_000).select(*_PAGE))


@check(
    "deep_item_page",
    "O3",
    "WITH i AS (SELECT l_linestatus AS session_id, *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k FROM lineitem WHERE l_linenumber < 7), "
    "n AS (SELECT session_id, count(*) AS n FROM i GROUP BY session_id) SELECT session_id, l_orderkey, l_linenumber, l_partkey, k FROM i JOIN n USING (session_id) WHERE k >= n * 9 // 10 AND k < n * 9 // 10 + 40",
)
def deep_item_page(spark, sf):
    """For every session forty undeleted items from nine tenths of it on, first by offset, then from the last one seen."""
    items = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("session_id"), *_PAGE, (F.col("l_linenumber") == 7).alias("deleted"))
    pages = StoredPages.write(items.filter(~F.col("deleted")), new_table_path(spark, "pages"), _PAGE, ["session_id"], rows_per_part=2000)
    shown = []
    for group in spark.read.parquet(f"{pages.path}/groups").collect():
        begin = group["n"] * 9 // 10
        half = pages.page(20, begin, session_id=group["session_id"])
        rest = pages.after(group["first"] + begin + 19, 20, session_id=group["session_id"])
        shown.append(half.unionByName(rest).select("session_id", *_PAGE, (F.col("_at") - group["first"]).alias("k")))
    return bigs(reduce(DataFrame.unionByName, shown))


def _items(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select(
        F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.concat(F.lit("qa-"), "turn").alias("id"), F.col("text").alias("question"),
        F.lit(1).cast("bigint").alias("created_at"), F.lit(1).cast("bigint").alias("updated_at"),
    )


_ITEMS_SQL = "items AS (SELECT 'conv-' || conv_id AS session_id, 'qa-' || turn AS id, text AS question, 1::BIGINT AS created_at, conv_id, turn, role FROM conversations)"


@check(
    "sharded_upsert",
    "R2",
    f"WITH {_ITEMS_SQL} SELECT session_id, id, CASE WHEN conv_id % 5 = 0 AND role = 'user' THEN 'edited ' || question ELSE question END AS question, created_at, "
    "CASE WHEN conv_id % 5 = 0 AND role = 'user' THEN 7 ELSE 1 END::BIGINT AS updated_at FROM items UNION ALL SELECT DISTINCT session_id, 'new', 'added', 7, 7 FROM items WHERE conv_id % 5 = 0",
)
def sharded_upsert(spark, sf):
    store = ShardedItems(spark, new_table_path(spark, "items"), 16).create(_items(spark, sf))
    turns = table(spark, sf, "conversations").filter("conv_id % 5 = 0")
    session, seven = F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.lit(7).cast("bigint")
    edited = turns.filter("role = 'user'").select(session, F.concat(F.lit("qa-"), "turn").alias("id"), F.concat(F.lit("edited "), "text").alias("question"), F.lit(1).cast("bigint").alias("created_at"), seven.alias("updated_at"))
    added = turns.select(session, F.lit("new").alias("id"), F.lit("added").alias("question"), seven.alias("created_at"), seven.alias("updated_at")).distinct()
    store.upsert(edited.unionByName(added))
    return store.read()


@check(
    "sharded_replace",
    "R3",
    f"WITH {_ITEMS_SQL} SELECT session_id, id, question FROM items WHERE conv_id % 7 <> 0 UNION ALL SELECT DISTINCT session_id, 'only', 'whole' FROM items WHERE conv_id % 7 = 0",
)
def sharded_replace(spark, sf):
    store = ShardedItems(spark, new_table_path(spark, "items"), 16).create(_items(spark, sf))
    turns = table(spark, sf, "conversations").filter("conv_id % 7 = 0")
    one = F.lit(1).cast("bigint")
    store.replace_sessions(turns.select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.lit("only").alias("id"), F.lit("whole").alias("question"), one.alias("created_at"), one.alias("updated_at")).distinct())
    return store.read().select("session_id", "id", "question")


PHRASES = ("le la", "die und", "the of", "in the", "than")


@check(
    "phrase_search",
    "R15",
    "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations), "
    f"p AS (SELECT unnest({list(PHRASES)}) AS phrase), q AS (SELECT phrase, string_split(phrase, ' ') AS q FROM p), "
    "s AS (SELECT conv_id, turn, w, unnest(range(0, len(w))) AS start FROM w) "
    "SELECT phrase, conv_id, turn, start FROM s JOIN q ON list_slice(w, start + 1, start + len(q)) = q",
)
def phrase_search(spark, sf):
    index = PhraseIndex(spark, new_table_path(spark, "postings"), 16).write(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    found = [index.search(p).select(F.lit(p).alias("phrase"), "row.conv_id", "row.turn", "start") for p in PHRASES]
    return bigs(reduce(DataFrame.unionByName, found))

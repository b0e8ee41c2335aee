"""Selection and shaping of finished pairs: variety, term lists, document records, exact repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions.text import py_lower_strip
from qaspark.operators.base import first_per_group, join_small, require


def opening(text: Column, words: int = 3) -> Column:
    """The first words of a text in lower case, as a rough topic of a question."""
    return F.array_join(F.slice(F.split(py_lower_strip(text), r"\s+"), 1, words), " ")


def diverse(df: DataFrame, keys: Sequence[Column], order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` records of each kind, the first in order; a kind is the values of ``keys``."""
    names = [f"_kind{i}" for i in range(len(keys))]
    return first_per_group(df.withColumns(dict(zip(names, keys))), names, list(order), most).drop(*names)


def first_of_text(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first record of each text over the whole table, compared in lower case without outer space."""
    return diverse(df, [py_lower_strip(F.coalesce(F.col(c), F.lit(""))) for c in columns], order, 1)


def pair_documents(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A row per chunk with its pairs as a nested list in record order; a chunk's pairs are bounded by the limits above."""
    pair = F.struct(*order, F.col("question").alias("question"), F.col("answer").alias("answer"))
    listed = df.groupBy("source_md", "chunk_index").agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    plain = F.transform("_pairs", lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer")))
    return listed.select("source_md", "chunk_index", plain.alias("pairs"))


def term_counts(df: DataFrame, terms: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Occurrences of listed words in each text: ``keys`` and ``hits``; texts without one are there with zero.

    Words are runs of letters and digits in lower case. The list is the user's; it is broadcast only if it is measured
    to be small. Counting happens before the shuffle.
    """
    require(len(keys) > 0, "rows must have a key")
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("term")
    listed = terms.select(F.lower("term").alias("term")).distinct()
    found = join_small(df.select(*keys, words), listed, ["term"], "left_semi")
    counted = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return df.select(*keys).join(counted, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("hits"))


def without_terms(df: DataFrame, terms: DataFrame, keys: Sequence[str], most: int = 0, text: str = "text") -> DataFrame:
    """Rows whose texts hold at most ``most`` listed words."""
    bad = term_counts(df, terms, keys, text).filter(F.col("hits") > most).select(*keys)
    return df.join(bad, list(keys), "left_anti")

"""Texts stay where they are while questions and responses travel.

A chunk goes through many model calls. If its row were joined with stored or given responses, its text would be shuffled once
for each call. ``TextStore`` writes the texts once, bucketed and sorted by a row key. A call then moves only the key, the hash of
the prompt and what earlier responses gave; afterwards the narrow rows are dealt out by the key and meet the buckets, which
are read in place. The text side of that join has no exchange, however many calls there are. Texts that follow from stored ones
(the contexts of a chunk) are not stored; they are built again where they are wanted.

Responses may be as long as texts, and many of one chunk repeat its sentences. ``PlacedResponses`` writes them in the order in
which they were asked, where they pack well, by a place. Only hashes and places move to find the one that answers a prompt, and what is
read of a response meets the rows at its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.session import PACKED, cut_in_buckets, new_table_path, shuffles_dropped

ROW_KEY = "_row"
# Where a response lies, the run of neighbours that it lies in, and the hash of its prompt in 32 bytes.
PLACE, BLOCK, HASH = "_place", "_block", "_hash"
# A run has two to this power of places: so many that a task that writes responses has few runs, so few that the runs fill buckets evenly.
RUN_BITS = 14
# Two tables bucketed by the block join by block and place without moving only if this is off; a session's own value wins.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
# How often a row of a store comes.
COPIES = "_copies"


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns: equal rows share a key, and a repeated task finds the same one."""
    usable = [F.col(name) for name in hashable(df)]
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*usable), F.xxhash64(F.lit(1), *usable))])


def hashable(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


@dataclass(frozen=True)
class TextStore:
    """A written table of texts by row key. ``columns`` maps a column of the rows to the stored column that it repeats.

    ``derive`` adds the columns ``derived`` to rows that have all of ``columns``. A store with derived columns has whole rows, which ``rows`` gives again.
    """

    table: str
    path: str
    columns: Mapping[str, str]
    derived: Sequence[str] = ()
    derive: Callable[[DataFrame], DataFrame] | None = None

    @classmethod
    def of(
        cls, marked: DataFrame, columns: Mapping[str, str], derived: Sequence[str] = (), derive: Callable[[DataFrame], DataFrame] | None = None
    ) -> TextStore:
        """Store the texts of ``marked`` (rows with a ``_row`` key): one shuffle, one row for each key."""
        spark = marked.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        name = f"qaspark_texts_{uuid.uuid4().hex}"
        path = new_table_path(spark, "texts")
        whole = bool(derived) and len(hashable(marked)) == len(marked.columns)
        kept = list(dict.fromkeys([*columns.values(), *(marked.columns if whole else [])]))
        texts = marked.select(ROW_KEY, *[c for c in kept if c != ROW_KEY]).repartition(buckets, ROW_KEY)
        if whole:
            firsts = [F.first(c).alias(c) for c in texts.columns if c != ROW_KEY]
            texts = texts.groupBy(ROW_KEY).agg(*firsts, F.count(F.lit(1)).alias(COPIES))
        else:
            texts = texts.dropDuplicates([ROW_KEY])
        with shuffles_dropped(spark):
            texts.write.bucketBy(buckets, ROW_KEY).sortBy(ROW_KEY).option("path", path).options(**PACKED).saveAsTable(name)
        return cls(name, path, dict(columns), tuple(derived), derive)

    def rows(self, marked: DataFrame) -> DataFrame:
        """The rows that were stored, read from the table where it has all of them."""
        stored = marked.sparkSession.table(self.table)
        if COPIES not in stored.columns:
            return marked
        copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(COPIES)))
        return stored.select(*marked.columns, copies.alias(COPIES)).drop(COPIES)

    def held(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c in self.columns or c in self.derived]

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns, *self.derived)

    def attach(self, df: DataFrame, names: list[str], if_read: bool = False) -> DataFrame:
        """``df`` with the text columns ``names`` again; every row of it has its key in the store.

        ``if_read`` tells the optimizer that a key comes once, so that a reader of other columns needs no join: its rows then stay where they are.
        """
        if not names:
            return df
        again = any(n in self.derived for n in names)
        read = [n for n in self.columns if n in names or again]
        stored = df.sparkSession.table(self.table).select(ROW_KEY, *[F.col(self.columns[n]).alias(n) for n in read])
        if if_read:
            stored = stored.groupBy(ROW_KEY).agg(*[F.first(n).alias(n) for n in read])
        joined = df.join(stored.hint("merge"), ROW_KEY, "left")
        return (self.derive(joined) if again else joined).select(*df.columns, *names)


def block_of(place: Column) -> Column:
    return F.shiftright(place, RUN_BITS)


def at_place(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """``rows`` and ``others`` of the same place. Tables of both are bucketed by the block, so nothing moves."""
    settings = rows.sparkSession.conf
    if settings.get(ALL_KEYS, None) is None:
        settings.set(ALL_KEYS, "false")
    # only places are held of ``others`` where rows are picked, so the responses among ``rows`` are not sorted for it
    return rows.join(others.hint("shuffle_hash" if how == "left_semi" else "merge"), [BLOCK, PLACE], how)


class PlacedResponses:
    """Responses ``(stage, prompt_hash, response)`` written in their order, one for each prompt of a stage."""

    @staticmethod
    def of(rows: DataFrame) -> DataFrame:
        """The written rows, the least response of each prompt, with its place and block. Each task writes its own; none moves."""
        numbered = rows.filter("response IS NOT NULL").select(
            "stage", F.unhex("prompt_hash").alias(HASH), "response", F.monotonically_increasing_id().alias(PLACE)
        )
        written = cut_in_buckets(numbered.withColumn(BLOCK, block_of(F.col(PLACE))), "responses", BLOCK)
        firsts = at_place(written, PlacedResponses._firsts(written), "left_semi")
        return firsts.select("stage", F.lower(F.hex(HASH)).alias("prompt_hash"), "response", PLACE, BLOCK)

    @staticmethod
    def _firsts(written: DataFrame) -> DataFrame:
        """Places of the least response of each prompt. Texts move only for prompts that have different responses."""
        digests = {"_d": F.xxhash64("response"), "_e": F.xxhash64(F.lit(1), "response")}
        told = written.select("stage", HASH, PLACE, *[d.alias(n) for n, d in digests.items()])
        differ = (F.min("_d") != F.max("_d")) | (F.min("_e") != F.max("_e"))
        first = told.groupBy("stage", HASH).agg(F.min(PLACE).alias(PLACE), differ.alias("_differ"))
        kept = first.select(
            PLACE, block_of(F.col(PLACE)).alias(BLOCK), F.when(F.col("_differ"), F.struct("stage", HASH)).alias("_odd")
        )
        firsts = cut_in_buckets(kept, "first-responses", BLOCK, [BLOCK, PLACE])
        odd = firsts.filter("_odd IS NOT NULL").select("_odd.*")
        if odd.isEmpty():
            return firsts.select(PLACE, BLOCK)
        several = written.select("stage", HASH, PLACE, BLOCK).join(odd, ["stage", HASH], "left_semi")
        least = at_place(written, several.select(PLACE, BLOCK), "left_semi").groupBy("stage", HASH).agg(
            F.min_by(PLACE, F.struct("response", PLACE)).alias(PLACE)
        )
        again = least.select(PLACE, block_of(F.col(PLACE)).alias(BLOCK)).unionByName(firsts.filter("_odd IS NULL").select(PLACE, BLOCK))
        return cut_in_buckets(again, "least-responses", BLOCK, [BLOCK, PLACE])

"""Stored layouts of the review store: pages that are read where they lie, shards that are rewritten alone, posting lists.

All three keep what a later read needs in the folder structure, so that Spark prunes folders before it opens a file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qaspark.operators.base import join_small, require
from qaspark.operators.ordering import dense_index
from qaspark.operators.review import replace_sessions, upsert
from qaspark.session import cut

# Most folders of a store of pages: writing and listing them takes longer than their rows.
MAX_PARTS = 1024


@dataclass(frozen=True)
class StoredPages:
    """Rows with a stored dense position, in folders of ``rows_per_part`` positions, or more where that would be over ``MAX_PARTS`` folders.

    Writing numbers the rows once, in one range shuffle. Rows lie in order in their files, so a large folder is pruned by row
    groups; how many positions it has is noted beside the rows. A page is then a range of positions: the folders outside it are not
    listed, and nothing is sorted but the page itself. With ``keys`` (a session, say) a small table of first positions says where
    each group begins, so a page of a group is a range too. ``after`` goes on from the last position that was seen.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ()
    rows_per_part: int = 50_000

    @classmethod
    def write(cls, df: DataFrame, path: str, order: Sequence[str], keys: Sequence[str] = (), rows_per_part: int = 50_000) -> StoredPages:
        """``keys`` and ``order`` together tell rows apart."""
        pages = cls(df.sparkSession, path, tuple(keys), rows_per_part)
        numbered = dense_index(df, [*keys, *order], "_at")
        span = max(rows_per_part, -(-numbered.count() // MAX_PARTS))
        if span > rows_per_part:
            df.sparkSession.range(span, span + 1).toDF("span").write.parquet(f"{path}/layout")
        placed = numbered.withColumn("_part", F.floor(F.col("_at") / span)).sortWithinPartitions("_part", "_at")
        placed.write.partitionBy("_part").parquet(f"{path}/rows")
        if keys:
            starts = pages.rows().groupBy(*keys).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
            starts.write.parquet(f"{path}/groups")
        return pages

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _span(self) -> int:
        """Positions of a folder."""
        noted = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout")
        if not noted.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(noted):
            return self.rows_per_part
        return self.spark.read.schema("span bigint").parquet(f"{self.path}/layout").first()["span"]

    def _range(self, low: int, high: int) -> DataFrame:
        """Positions ``low`` to ``high`` - 1 in order; at most a page, so sorting it is bounded."""
        span = self._span()
        parts = F.col("_part").between(low // span, max(low, high - 1) // span)
        return self.rows().filter(parts & (F.col("_at") >= low) & (F.col("_at") < high)).orderBy("_at").drop("_part")

    def _group(self, group: dict) -> tuple[int, int]:
        """First position of a group and the one after its last."""
        if not self.keys:
            return 0, 1 << 62
        found = self.spark.read.parquet(f"{self.path}/groups")
        for key in self.keys:
            found = found.filter(F.col(key).eqNullSafe(F.lit(group[key])))
        row = found.select("first", "n").first()
        return (row["first"], row["first"] + row["n"]) if row else (0, 0)

    def page(self, limit: int, offset: int = 0, **group) -> DataFrame:
        require(limit >= 1 and offset >= 0, "limit must be positive and offset not negative")
        first, end = self._group(group)
        return self._range(first + offset, max(first + offset, min(first + offset + limit, end)))

    def after(self, at: int, limit: int, **group) -> DataFrame:
        """The next ``limit`` rows behind position ``at`` (column ``_at`` of the last row seen)."""
        first, end = self._group(group)
        low = max(at + 1, first)
        return self._range(low, max(low, min(low + limit, end)))


@dataclass(frozen=True)
class ShardedItems:
    """Current review items in folders by a hash of the session; a change rewrites the folders of its sessions and no other.

    The stored side is read in place, folders of other shards are pruned. What is merged is written before the folders are
    replaced, so a lost executor finds its input again. A session of any size lies in one folder but in many files: rows are
    rebalanced, not gathered, before they are written.
    """

    spark: SparkSession
    path: str
    shards: int = 64

    def shard(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.shards)).cast("int").alias("_shard")

    def create(self, items: DataFrame) -> ShardedItems:
        self._spread(items.withColumn("_shard", self.shard())).write.partitionBy("_shard").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_shard")

    def current(self, changes: DataFrame) -> DataFrame:
        """Stored items of the shards that ``changes`` fall into; there are at most ``shards`` numbers."""
        touched = [r["_shard"] for r in changes.select(self.shard()).distinct().collect()]
        return self.spark.read.parquet(self.path).filter(F.col("_shard").isin(touched)).drop("_shard")

    def _spread(self, items: DataFrame) -> DataFrame:
        return items.hint("rebalance", "_shard")

    def _rewrite(self, merged: DataFrame, columns: list[str]) -> None:
        settled = cut(merged.select(*columns), "merged-items")
        placed = self._spread(settled.withColumn("_shard", self.shard()))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_shard").parquet(self.path)

    def upsert(self, changes: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> None:
        stored = self.current(changes)
        self._rewrite(upsert(stored, changes.select(*stored.columns), order), stored.columns)

    def replace_sessions(self, items: DataFrame) -> None:
        stored = self.current(items)
        self._rewrite(replace_sessions(stored, items.select(*stored.columns)), stored.columns)


@dataclass(frozen=True)
class PhraseIndex:
    """Posting lists (word, row, position) in folders by a hash of the word.

    A phrase is found from its rarest word: where it could begin follows from each position, and the other words, rarest first,
    keep the beginnings they agree with. Beginnings are broadcast only when they are measured small, so a word that every
    row holds is read in its folder and not shuffled. Words are parts between white space in lower case; null texts have none.
    """

    spark: SparkSession
    path: str
    shards: int = 64

    @staticmethod
    def words(text: Column) -> Column:
        parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
        return F.filter(parts, lambda w: w != "")

    def _shard(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.shards)).cast("int")

    def write(self, df: DataFrame, keys: Sequence[str], text: str) -> PhraseIndex:
        each = df.select(F.struct(*keys).alias("row"), F.posexplode(self.words(F.col(text))).alias("pos", "word"))
        placed = each.withColumn("_shard", self._shard(F.col("word"))).hint("rebalance", "_shard")
        placed.write.partitionBy("_shard").parquet(self.path)
        return self

    def _places(self, word: str, offset: int) -> DataFrame:
        """(``row``, ``start``): where a phrase that has ``word`` at ``offset`` would begin."""
        shard = self.spark.range(1).select(self._shard(F.lit(word))).first()[0]
        found = self.spark.read.parquet(self.path).filter((F.col("_shard") == shard) & (F.col("word") == word))
        return found.select("row", (F.col("pos") - offset).alias("start")).filter("start >= 0")

    def search(self, phrase: str) -> DataFrame:
        """(``row``, ``start``) of every occurrence of the phrase; the order of words counts."""
        words = [w for w in phrase.lower().split() if w]
        require(bool(words), "the phrase must have a word")
        counts = {w: self._places(w, 0).count() for w in dict.fromkeys(words)}
        order = sorted(range(len(words)), key=lambda i: (counts[words[i]], i))
        begins = self._places(words[order[0]], order[0])
        for i in order[1:]:
            begins = join_small(self._places(words[i], i), begins, ["row", "start"], "left_semi")
        return begins

"""Exact duplicates by a streaming state: DataFrame and SQL functions only.

Digests are kept as the state of a streaming aggregation in a disk-backed store, without any expiry: for each digest
the number of rows, the row that stays and where its content is found (id and hash of its original text). Rows
whose digest was seen are hits; their whole normalised texts are compared with the kept row's, and rows that only
share a digest are grouped anew by their texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qaspark.llm.common import ROW, keep_rows, row_id, text_of
from qaspark.session import cut, new_table_path

SPACES = " \t\n\x0b\x0c\r"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space; one byte search per character is faster than a pattern."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def rank_of() -> Column:
    """Orders equal texts: most code points first, then the smallest id, nulls last."""
    return F.struct((-F.col("points")).alias("points"), F.isnull("doc_id").alias("unnamed"), "doc_id", *ROW)


@dataclass(frozen=True)
class StreamingExactDedup:
    """One row per document with its group, after ``normalise`` and ``digest``.

    Input ``doc_id``, ``text``; other columns are ignored. Null texts count as empty, and all empty texts are equal.
    Of equal texts the longest original stays (code points), then the smallest id, then null ids. Rows that are
    repeated whole count each; exactly one of them may stay. An empty table gives no rows.
    Returns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the row name.
    """

    digest: Callable[[Column], Column] = sha256
    files_per_batch: int = 1000

    def records(self, docs: DataFrame) -> DataFrame:
        """Narrow rows: what the state needs, no text."""
        normal = without_spaces(F.col("text"))
        rows = docs.select("doc_id", text_of().alias("text"), *row_id())
        return rows.select(
            "doc_id", *ROW, F.length("text").cast("bigint").alias("points"), self.digest(normal).alias("digest"), sha256(normal).alias("text_sha256")
        )

    def state(self, stream: DataFrame) -> DataFrame:
        """The keyed state over a stream of ``records``: rows seen and the row that stays, for each digest."""
        return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank_of()).alias("keep"))

    def run_state(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Write the records, feed them through the state; the written records and each digest's last version.

        A batch writes the changed keys under its own number, so a batch repeated after a failure replaces its
        own output. State and progress live in the shared folder.
        """
        spark = records.sparkSession
        source, target, progress = (new_table_path(spark, x) for x in ("exact-records", "exact-state", "exact-progress"))
        records.write.parquet(source)
        session = spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        # files of small states are not stretched in advance
        session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        stream = session.readStream.schema(records.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(source)
        query = (
            self.state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
        return spark.read.schema(records.schema).parquet(source), self._last(spark, records, target)

    def _last(self, spark: SparkSession, records: DataFrame, target: str) -> DataFrame:
        empty = self.state(records.limit(0))
        empty.write.parquet(f"{target}/batch=-1")  # an empty stream runs no batch
        versions = spark.read.schema(empty.schema.add("batch", "long")).parquet(target)
        return versions.groupBy("digest").agg(F.max_by(F.struct("n", "keep"), "batch").alias("s")).select("digest", "s.n", "s.keep")

    def __call__(self, docs: DataFrame) -> DataFrame:
        records, state = self.run_state(self.records(docs))
        state = cut(state, "exact-groups")
        hits = state.filter("n > 1")
        members = cut(self.members(docs, records, hits), "exact-members")
        clash = cut(self.clashes(members, hits), "exact-clashes")
        groups = records.join(state, "digest")
        if clash.isEmpty():  # the usual case: equal digests, equal bytes
            return self.rows(groups)
        return self.rows(self.regrouped(groups, records, members, clash))

    def members(self, docs: DataFrame, records: DataFrame, hits: DataFrame) -> DataFrame:
        """Whole normalised texts of all rows that share a digest; the texts are shuffled once."""
        named = docs.select(text_of().alias("text"), *row_id())
        wanted = records.join(hits.select("digest"), "digest").select(*ROW, "digest").distinct()
        return named.join(wanted, list(ROW)).select(*ROW, "digest", without_spaces(F.col("text")).alias("normal"))

    def clashes(self, members: DataFrame, hits: DataFrame) -> DataFrame:
        """Digests of which some member's bytes differ from the kept row's."""
        kept = hits.select("digest", "keep._r1", "keep._r2").join(members, ["digest", *ROW]).select("digest", F.col("normal").alias("first"))
        return members.join(cut(kept.dropDuplicates(["digest"]), "exact-kept"), "digest").filter("normal <> first").select("digest").distinct()

    def regrouped(self, groups: DataFrame, records: DataFrame, members: DataFrame, clash: DataFrame) -> DataFrame:
        """Rows of clashing digests grouped by the texts themselves, all others as they were."""
        texts = members.join(clash, "digest").dropDuplicates([*ROW])
        parted = records.join(texts.select(*ROW, "normal"), list(ROW))
        apart = parted.groupBy("digest", "normal").agg(F.count(F.lit(1)).alias("n"), F.min(rank_of()).alias("keep"))
        again = parted.join(apart, ["digest", "normal"]).select(*groups.columns)
        return groups.join(clash, "digest", "left_anti").unionByName(again)

    def rows(self, groups: DataFrame) -> DataFrame:
        """One row per document. Rows repeated whole are counted, and only the first of them can stay."""
        same = groups.groupBy("doc_id", *ROW, "text_sha256", "n", "keep").agg(F.count(F.lit(1)).alias("copies"))
        mine = (F.col("keep._r1") == F.col("_r1")) & (F.col("keep._r2") == F.col("_r2"))
        copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
        return same.select("doc_id", "keep", "n", "text_sha256", *ROW, copy).select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (mine & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
            *ROW,
        )

    def keep(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its own columns, one row of each group."""
        return keep_rows(docs, cut(self(docs).filter("kept"), "exact-kept-rows"))

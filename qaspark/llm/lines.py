"""Repeated runs of lines by winnowing over line hashes: DataFrame and SQL functions only.

A run is ``run`` lines in a row. Its fingerprint is the smallest line hash in it (the first of equals), so two equal
runs have the same fingerprint at the same place: that is the guarantee. Fingerprints that occur at one position
only are dropped; the others' positions are joined with the runs around them, which reach to both sides of the
fingerprint, and equal runs are told by a digest of their whole lines. Overlapping later runs add up to maximal
repeats. Counts and first positions are partial sums, so a line that a third of all documents share is no
single task's work, and no pairs of positions are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import ROW, keyed
from qaspark.session import cut


@dataclass(frozen=True)
class RepeatedLines:
    """Deletes lines that lie in a run of ``run`` lines which occurs earlier (order: id, text hash, line).

    Lines are parted by \\n and compared whole. Input ``doc_id``, ``text``; other columns are ignored. A null text is one
    empty line, as is an empty text. Texts of fewer lines lose nothing. Runs are judged on the input; a run that
    overlaps its own copy loses the later lines. Repeated rows have no order, so they share one answer: a run is
    earlier only if it is in another row or at an earlier line. Null ids are one id. Texts of any length are parted whole. An
    empty table gives no rows. Returns ``doc_id``, ``n_lines``, ``kept`` (array of lines).
    """

    run: int = 2

    def windows(self, rows: DataFrame) -> DataFrame:
        """Every run: its first line, its fingerprint and the digest of its lines."""
        t = self.run
        lined = rows.select(*ROW, F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= t)
        hashed = lined.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
        run = lambda s: F.struct(
            s.alias("s"),
            F.array_min(F.slice("hashes", s + 1, t)).alias("fingerprint"),
            F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", s + 1, t)))).alias("digest"),
        )
        return hashed.select(*ROW, F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - t), run)))

    def repeats(self, rows: DataFrame) -> DataFrame:
        """(``_r1``, ``_r2``, ``s``): runs that occur earlier."""
        windows = cut(self.windows(rows), "line-runs")
        shared = windows.groupBy("fingerprint").agg(F.min(F.struct(*ROW, "s")).alias("lo"), F.max(F.struct(*ROW, "s")).alias("hi"))
        shared = cut(shared.filter("lo < hi").select("fingerprint"), "shared-fingerprints")
        rivals = windows.join(shared, "fingerprint").drop("fingerprint")
        firsts = rivals.groupBy("digest").agg(F.min(F.struct(*ROW, "s")).alias("lo"), F.max(F.struct(*ROW, "s")).alias("hi"))
        firsts = cut(firsts.filter("lo < hi").select("digest", "lo"), "first-runs")
        return rivals.join(firsts, "digest").filter(F.struct(*ROW, "s") > F.col("lo")).select(*ROW, "s")

    def __call__(self, docs: DataFrame) -> DataFrame:
        rows = keyed(docs)
        starts = self.repeats(rows).groupBy(*ROW).agg(F.collect_set("s").alias("starts"))
        gone = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (self.run - 1))))
        lined = rows.join(starts, list(ROW), "left").select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.element_at("lines", i + 1))
        return lined.select("doc_id", F.size("lines").alias("n_lines"), F.when(F.size("gone") == 0, F.col("lines")).otherwise(kept).alias("kept"))

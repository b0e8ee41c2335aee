"""Order-based operators that stay parallel: dense numbers and next-row values without a one-task window.

The rows are range-sorted once and written with their block number, so every later read sees the
same blocks. What crosses block borders is one row per block, which is bounded by the number of
partitions and therefore safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from qaspark.operators.base import fits_broadcast, join_small
from qaspark.session import cut

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def sorted_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition and sort by ``keys`` then ``order``; add ``_blk`` and ``_pos`` and fix them.

    ``order`` must tell rows apart, which also lets a single hot key be split over many blocks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    columns = [*keys, *order]
    placed = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    stamp = F.monotonically_increasing_id()
    return cut(
        placed.withColumns(
            {
                "_blk": F.shiftright(stamp, _POSITION_BITS).cast("int"),
                "_pos": stamp.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
            }
        ),
        "blocks",
    )


def _block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))


def dense_index(df: DataFrame, order: Sequence[str], to: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in ``order``: one shuffle, no global window over the rows."""
    blocks = sorted_blocks(df, [], order)
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block: the window runs over the number of partitions, not over the data
    offsets = _block_sizes(blocks).select(
        "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        blocks.join(F.broadcast(offsets), "_blk")
        .withColumn(to, F.col("_pos") + F.col("_offset"))
        .drop("_blk", "_pos", "_offset")
    )


def dense_index_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], to: str = "idx") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ...; a hot group is numbered by many tasks.

    The rows are numbered as a whole, which takes the one range shuffle; a group's numbers start at its first one. The table of first
    numbers has a row for each group: measured small it is broadcast, and the rows move no further. With more groups than
    that, rows are numbered inside their blocks and counts are carried across block borders.
    """
    placed = dense_index(df, [*keys, *order], "_at")
    first = cut(placed.groupBy(*keys).agg(F.min("_at").alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first"), "group-starts")
    if fits_broadcast(first):
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        return placed.join(F.broadcast(first), same).select(*df.columns, (F.col("_at") - F.col("_first")).alias(to))
    return _index_by_blocks(df, keys, order, to)


def _index_by_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """Only the first group of a block can have begun in an earlier block, so carried counts are one row per block at most."""
    blocks = sorted_blocks(df, keys, order)
    counts = blocks.groupBy("_blk", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    group = F.struct(*keys)
    ends = counts.groupBy("_blk").agg(
        F.min_by(group, "_first").alias("_head"),
        F.max_by(group, "_first").alias("_tail"),
        F.max_by("_n", "_first").alias("_out"),
        (F.count(F.lit(1)) == 1).alias("_one"),
    )
    # one row per block: a running sum that starts anew where a block's last group begins inside it
    along = Window.orderBy("_blk")
    same = [F.col(f"_head.{k}").eqNullSafe(F.col(f"_prev.{k}")) for k in keys]
    goes_on = F.coalesce(reduce(and_, same, F.col("_prev").isNotNull()), F.lit(False))
    chained = ends.withColumn("_prev", F.lag("_tail").over(along)).withColumn("_on", goes_on)
    chained = chained.withColumn("_chain", F.sum(F.when(F.col("_on") & F.col("_one"), 0).otherwise(1)).over(along))
    chained = chained.withColumn("_sum", F.sum("_out").over(Window.partitionBy("_chain").orderBy("_blk")))
    carried = chained.withColumn("_carried", F.when(F.col("_on"), F.lag("_sum").over(along))).filter("_carried is not null")
    carried = carried.select("_blk", "_head", "_carried")
    local = F.row_number().over(Window.partitionBy("_blk", *keys).orderBy("_pos")) - 1
    # keys may be long texts, so the table of blocks is measured before it is broadcast
    numbered = join_small(blocks.withColumn("_local", local), carried, ["_blk"], "left")
    mine = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_head.{k}")) for k in keys], F.col("_head").isNotNull())
    return numbered.select(*df.columns, (F.col("_local") + F.when(mine, F.col("_carried")).otherwise(0)).alias(to))


def next_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, to: str) -> DataFrame:
    """Value of the following row in the same group, null for the last one.

    ``lead`` runs inside (block, group); the last row of a block looks at the first row of the next
    non-empty block, taken from a table of one row per block.
    """
    blocks = sorted_blocks(df, keys, order)
    heads = blocks.filter(F.col("_pos") == 0).select("_blk", F.struct(*keys, F.col(value).alias("_v")).alias("_head"))
    # one row per block again, so this ordered window is bounded by the number of partitions
    heads = heads.select("_blk", F.lead("_head").over(Window.orderBy("_blk")).alias("_next"))
    within = Window.partitionBy("_blk", *keys).orderBy("_pos")
    # wrapped in a struct, a following row with a null value differs from no following row
    inside = blocks.withColumn("_lead", F.lead(F.struct(F.col(value).alias("_v"))).over(within))
    same_group = F.col("_next").isNotNull()
    for key in keys:
        same_group = same_group & F.col(key).eqNullSafe(F.col(f"_next.{key}"))
    crossing = F.when(F.col("_lead").isNull() & same_group, F.col("_next._v"))
    # the values may be long texts, so even this one-row-per-block table is measured first
    return (
        join_small(inside, heads, ["_blk"], "left")
        .withColumn(to, F.when(F.col("_lead").isNotNull(), F.col("_lead._v")).otherwise(crossing))
        .drop("_lead", "_next", "_blk", "_pos")
    )

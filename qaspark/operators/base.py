"""What an operator is, and the small helpers all of them share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from qaspark.session import cut

Operator = Callable[[DataFrame], DataFrame]

# A side may be broadcast only below these sizes, both counted before the hint is given.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Chain:
    """Operators applied one after another. Most only plan; those that must write something first run jobs at the call."""

    operators: Sequence[Operator]

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda rows, operator: rows.transform(operator), self.operators, df)


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def entries(array: str) -> Column:
    """Argument of an explode over a parsed array column.

    Over a bare column Spark infers ``size(array) > 0`` and pushes that filter, with the whole parsing
    expression copied into it, below the projections; over an expression it does not. The arrays hold
    no nulls, so the compaction changes nothing.
    """
    return F.array_compact(F.col(array))


def read_fields(df: DataFrame, fields: dict[str, Column], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add columns parsed from a row and drop rows that ``keep`` refuses, in one generator step.

    A plain filter on parsed columns would be pushed below the projection with its expressions copied
    into it, and a chain of such stages would parse each response many times over. The rows of a
    generator are fixed, so each response is parsed once.
    """
    record = F.array(F.struct(*[value.alias(name) for name, value in fields.items()]))
    rest = [c for c in df.columns if c not in fields]
    return df.select(*rest, F.inline(F.filter(record, keep) if keep else record))


def fold_in_blocks(array: Column, start: Column, step: Callable[[Column, Column], Column], size: int = 256) -> Column:
    """A fold whose state has a growing list ``done``, in time close to linear.

    Appending copies the list. Inside a block of ``size`` elements the step appends to a list of its own, and the long
    list is copied once for each block. All other fields of the state must be small.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(size))
    blocks = F.transform(starts, lambda i: F.slice(array, i, size))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, acc.withField("done", F.slice(acc.done, 1, 0)), step)
        return F.aggregate(F.array(inner), acc, lambda old, new: new.withField("done", F.concat(old.done, new.done)))

    return F.aggregate(blocks, start, block)


def fits_broadcast(df: DataFrame) -> bool:
    """True when ``df`` is proven small: one parallel pass counts its rows and the bytes of their JSON text."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return seen["n"] <= BROADCAST_ROWS and (seen["b"] or 0) <= BROADCAST_BYTES


def join_small(df: DataFrame, side: DataFrame, on, how: str) -> DataFrame:
    """Broadcast ``side`` when it is proven small, else a shuffled join.

    A side too large to broadcast is written first: over a plain table AQE can split a hot key of
    ``df``, over an aggregate it cannot.
    """
    return df.join(F.broadcast(side) if fits_broadcast(side) else cut(side, "side"), on, how)


FAN = 8


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` tells rows apart.

    ``row_number() <= n`` lets Spark drop rows per input partition before the shuffle
    (WindowGroupLimit), so a group holding a third of the table sends at most ``n`` rows per
    partition. That rewrite stops at ``spark.sql.optimizer.windowGroupLimitThreshold``; above it the
    group is cut in a tree of salts: every level keeps the first ``n`` of a salt and joins ``FAN`` salts to one, so
    no task meets more than ``FAN`` times ``n`` rows of a group, whatever the number of partitions is.
    """
    require(n > 0, "n must be positive")
    spark = df.sparkSession
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions", "200")) if n > limit else 1
    # the salt follows from the row alone, so a repeated task salts it the same way
    hashed = [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts))) if salts > 1 else df
    while salts > 1:
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = rows.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= n).drop("_rn")
        salts = -(-salts // FAN)
        rows = rows.withColumn("_salt", F.floor(F.col("_salt") / FAN)) if salts > 1 else rows.drop("_salt")
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= n).drop("_rn")


@dataclass(frozen=True)
class LimitPerChunk:
    """First ``max_per_chunk`` rows of every chunk in record order."""

    max_per_chunk: int

    def __post_init__(self) -> None:
        require(self.max_per_chunk > 0, "max_per_chunk must be positive")

    def __call__(self, df: DataFrame) -> DataFrame:
        keyed = df.withColumns(
            {
                "_src": F.coalesce("source_md", F.lit("")),
                "_chunk": F.coalesce("chunk_index", F.lit(0)),
            }
        )
        return first_per_group(keyed, ["_src", "_chunk"], ["rec_ord"], self.max_per_chunk).drop("_src", "_chunk")

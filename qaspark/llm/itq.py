"""Near duplicates of vectors by iterative quantisation, multi-index Hamming tables and the original vectors.

Codes. Unit vectors are turned by rotations that make the signs of their components balanced and close to the components:
on a bounded sample, binary codes and the rotation are improved in turn. The signs, cut into blocks of as many bits
as the number of rows asks for, are the code; each block has a table of its own.

Tables. Two vectors are candidates if some block of theirs differs in at most one bit and their whole codes in
at most a radius. How many blocks that takes is measured at the time of fitting: sample vectors are paired with vectors at
exactly the threshold's cosine, and blocks are added until the tables find ``recall`` of these pairs.

Dense groups. Copies and near copies would fill a bucket with pairs. So every vector first joins, among the first vectors of
its buckets, one within half the threshold's angle. Members of such a ball are linked to one another, all of them, by the
triangle inequality, and need not be compared. Tables hold balls instead of vectors; a pair of balls is settled by the angle
between their centres where it can be, then vector against ball, and only what is still open vector against vector.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from qaspark.llm.common import ship
from qaspark.llm.simhash import components
from qaspark.session import cut

MARGIN = 1e-7  # angles closer than this to a bound are not settled by it
WORD = 63


def rotation(dims: int, bits: int, seed: int, sample: np.ndarray | None, steps: int = 30) -> np.ndarray:
    """``dims`` x ``bits`` (``bits`` <= ``dims``): principal axes, turned so that signs lie close to the components."""
    rng = np.random.default_rng([seed, dims, bits])
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    if sample is None or len(sample) < 2 * bits:
        return np.linalg.qr(rng.standard_normal((dims, bits)))[0]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :bits]
    low = sample @ axes
    for _ in range(steps):
        codes = np.where(low @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(low.T @ codes)
        turn = left @ right
    return axes @ turn


@dataclass(frozen=True)
class Codes:
    """Everything that turns a vector into blocks: for the learnt length its rotations, for others random ones."""

    blocks: int
    width: int
    radius: int
    learnt: dict

    @property
    def bits(self) -> int:
        """How many bits are kept in words, for the distance of whole codes."""
        return self.blocks * self.width

    def projection(self, dims: int) -> np.ndarray:
        if dims not in self.learnt:
            self.learnt[dims] = projection(dims, self.blocks * self.width)
        return self.learnt[dims]

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Bits of every row, ``blocks`` times ``width`` of them."""
        return unit @ self.projection(unit.shape[1])[:, : self.blocks * self.width] >= 0


def rotations(dims: int, sample: np.ndarray | None) -> Iterator[np.ndarray]:
    """One rotation after the other, each from another start and another half of the sample."""
    for n in itertools.count():
        yield rotation(dims, min(dims, 64), n, None if sample is None else sample[n % 2 :: 2])


def projection(dims: int, bits: int) -> np.ndarray:
    """Random rotations side by side, for a length that was not learnt."""
    enough = itertools.islice(rotations(dims, None), math.ceil(bits / min(dims, 64)))
    return np.concatenate(list(enough), axis=1)[:, :bits]


def trials(sample: np.ndarray, cosine: float, size: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at exactly ``cosine``: the first half part in any direction, the second where sample vectors part."""
    rng = np.random.default_rng(1)
    x = sample[rng.integers(0, len(sample), size)]
    across = rng.standard_normal(x.shape)
    across[size // 2 :] = across[size // 2 :] * 1e-6 + sample[rng.integers(0, len(sample), size - size // 2)]
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * across


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float) -> Codes:
    """Width from the number of rows, so that buckets do not fill as tables grow; number of blocks and radius from trials."""
    width = min(30, max(12, math.ceil(math.log2(max(rows, 2)))))
    dims = sample.shape[1]
    if dims < 2 or not len(sample):
        return Codes(1, width, width, {})
    x, y = trials(sample, cosine)
    weights = np.empty((dims, 0))
    for turn in rotations(dims, sample):
        weights = np.concatenate([weights, turn], axis=1)
        whole = weights.shape[1] // width
        if not whole:
            continue
        used = weights[:, : whole * width]
        differ = ((x @ used >= 0) != (y @ used >= 0)).reshape(len(x), whole, width).sum(axis=2)
        halves = np.logical_or.accumulate(differ <= 1, axis=1).reshape(2, len(x) // 2, whole).mean(axis=1)
        blocks = int(np.searchsorted(halves.min(axis=0), recall)) + 1
        if blocks <= whole or whole >= 64:
            blocks = min(blocks, whole)
            radius = int(np.quantile(differ[:, :blocks].sum(axis=1), 0.9995)) + 1
            return Codes(blocks, width, radius, {dims: used[:, : blocks * width]})


def _dot(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Cosines of the rows of two list columns, in double precision; rows of different lengths have none (-2)."""
    la, lb = (np.asarray(c.value_lengths()) for c in (a, b))
    va, vb = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (a, b))
    out = np.full(len(la), -2.0)
    sa, sb = (np.concatenate(([0], np.cumsum(n)))[:-1] for n in (la, lb))
    for d in np.unique(la[la == lb]):
        at = np.nonzero((la == d) & (lb == d))[0]
        x = va[sa[at][:, None] + np.arange(d)]
        y = vb[sb[at][:, None] + np.arange(d)]
        out[at] = (unit(x) * unit(y)).sum(axis=1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_dot(a, b))


def cosine_of(a: str, b: str) -> Column:
    """Not to be computed again where a filter reads it, hence not deterministic by name."""
    return F.arrow_udf(_cosines, T.DoubleType()).asNondeterministic()(a, b)


@dataclass(frozen=True)
class EmbeddingNearDuplicates:
    """Direct links and groups of vectors with a cosine of ``cosine`` or more.

    Input ``vec_id``, ``embedding`` (numbers); other columns are ignored. Vectors that are null, empty, all zero or hold null or
    non-finite components link with nothing, and so do vectors of different lengths. Equal vectors under different ids are
    linked; repeated rows (same id, same vector) are one vector. Rows of one id with different vectors, or with a null id, are
    vectors of their own whose groups take part; a null id never names a group unless all its ids are null. Links are found
    at ``recall`` or more of pairs exactly at the threshold, and surer the closer the pair; every link is decided by the
    original vectors. An empty table gives no rows.
    Returns ``vec_id``, ``n_links``, ``component_id``, ``kept``, one row for each row.

    The rotations learn from the ``sample`` // length vectors (256 or more) with the smallest hashes, of the commonest length; every vector is coded.
    """

    cosine: float = 0.95
    recall: float = 0.99
    sample: int = 1 << 21

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)

    def distinct(self, table: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All rows with the name of their vector (null if unusable), and the different usable vectors."""
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        v = F.transform("embedding", lambda x: x.cast("double"))
        rows = table.select("vec_id", F.col("embedding").alias("v"), (F.size("embedding") > 0).alias("some"), v.alias("d"))
        usable = F.col("some") & F.forall("d", finite) & F.exists("d", lambda x: x != 0)
        rows = cut(rows.select("vec_id", F.when(usable, F.col("v")).alias("v")), "vectors")
        copies = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.countDistinct(F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).alias("copies"))
        return rows, cut(copies.select(F.monotonically_increasing_id().alias("u"), "v", "first", "copies"), "distinct-vectors")

    def codes(self, vectors: DataFrame) -> Codes:
        by_length = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        if not by_length:
            return fit(np.empty((0, 1)), 0, self.cosine, self.recall)
        d = by_length[0]["d"]
        drawn = vectors.filter(F.size("v") == d).orderBy(F.xxhash64("v")).select("v").limit(max(256, self.sample // d)).toArrow()
        sample = unit(drawn["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
        return fit(sample, vectors.count(), self.cosine, self.recall)

    def coded(self, vectors: DataFrame, codes: Codes) -> DataFrame:
        """(``u``, ``w0``, ``w1``, ..., ``blocks``): the code in words for its distance and in blocks for the tables."""
        words = math.ceil(codes.bits / WORD)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("v")
                sizes = np.asarray(column.value_lengths())
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                bits = np.zeros((len(sizes), codes.blocks * codes.width), bool)
                for d in np.unique(sizes):
                    at = np.nonzero(sizes == d)[0]
                    bits[at] = codes.of(unit(flat[starts[at][:, None] + np.arange(d)]))
                packed = [bits[:, i * WORD : min((i + 1) * WORD, codes.bits)] for i in range(words)]
                whole = [part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64)) for part in packed]
                cutup = bits.reshape(len(bits), codes.blocks, codes.width) @ (np.int64(1) << np.arange(codes.width, dtype=np.int64))
                blocks = pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * codes.blocks, pa.array(cutup.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("u"), *map(pa.array, whole), blocks], ["u", *[f"w{i}" for i in range(words)], "blocks"])

        named = "".join(f"w{i} bigint, " for i in range(words))
        return cut(vectors.select("u", "v").mapInArrow(encode, f"u bigint, {named}blocks array<bigint>"), "codes")

    def balls(self, vectors: DataFrame, coded: DataFrame, codes: Codes) -> DataFrame:
        """(``u``, ``c``, ``r``): the ball of each vector, named by the vector at its centre, and its angle from it."""
        words = [c for c in coded.columns if c.startswith("w")]
        filed = coded.select("u", *words, F.posexplode("blocks").alias("t", "key"))
        firsts = filed.groupBy("t", "key").agg(F.min(F.struct("u", *words)).alias("f"), F.max("u").alias("last")).filter("f.u < last")
        near = hamming([F.col(w) for w in words], [F.col(f"f.{w}") for w in words]) <= codes.radius
        pairs = filed.join(firsts.drop("last"), ["t", "key"]).filter((F.col("u") != F.col("f.u")) & near).select("u", F.col("f.u").alias("c")).distinct()
        v = vectors.select("u", "v")
        close = pairs.join(v, "u").join(v.toDF("c", "w"), "c").select("u", "c", cosine_of("v", "w").alias("cos"))
        close = close.filter(F.acos(F.least("cos", F.lit(1.0))) <= self.angle / 2 - MARGIN)
        # a vector may also be its own centre
        own = vectors.select("u", F.col("u").alias("c"), F.lit(1.0).alias("cos"))
        best = close.unionByName(own).groupBy("u").agg(F.min(F.struct("c", "cos")).alias("m"))
        chosen = cut(best.select("u", "m.c", F.acos(F.least("m.cos", F.lit(1.0))).alias("r")), "chosen-centres")
        # whoever is alone in a ball becomes its centre
        alone = chosen.groupBy("c").agg(F.count(F.lit(1)).alias("size")).filter("size = 1").select("c", F.lit(True).alias("alone"))
        moved = F.col("alone") | (F.col("u") == F.col("c"))
        moved = F.coalesce(moved, F.lit(False))
        both = chosen.join(alone, "c", "left")
        return cut(both.select("u", F.when(moved, F.col("u")).otherwise(F.col("c")).alias("c"), F.when(moved, 0.0).otherwise(F.col("r")).alias("r")), "balls")

    def ball_pairs(self, coded: DataFrame, balls: DataFrame, sizes: DataFrame, codes: Codes) -> DataFrame:
        """(``a``, ``b``), a < b: balls that meet in a table, one bit off at most, with centres' codes close enough."""
        words = [c for c in coded.columns if c.startswith("w")]
        bits = codes.blocks * codes.width
        slack = F.when(F.col("size") > 1, F.ceil(F.col("radius") / math.pi * bits * 1.5) + 2).otherwise(0).cast("int")
        centres = sizes.join(coded.select(F.col("u").alias("c"), *words), "c").select("c", *words, slack.alias("slack"))
        entries = coded.select("u", F.posexplode("blocks").alias("t", "key")).join(balls.select("u", "c"), "u").select("c", "t", "key").distinct()
        filed = cut(entries.join(centres, "c"), "tables")
        flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(codes.width)])
        asked = filed.select(F.col("c").alias("a"), *[F.col(w).alias(f"a{w}") for w in words], F.col("slack").alias("aslack"), "t", "key", F.explode(flips).alias("flip"))
        asked = asked.withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")
        met = asked.join(filed, ["t", "key"]).filter((F.col("a") < F.col("c")) & (hamming([F.col(w) for w in words], [F.col(f"a{w}") for w in words]) <= codes.radius + F.col("slack") + F.col("aslack")))
        return cut(met.select("a", F.col("c").alias("b")).distinct(), "ball-pairs")

    def links(self, vectors: DataFrame, balls: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
        """(``u``, ``c``, ``n``): how many vectors, copies included, of each other ball a vector is linked to, where any."""
        v = vectors.select("u", "v")
        centre = sizes.select("c", "size", "weight", "radius").join(v.withColumnRenamed("u", "c"), "c")
        a, b = (centre.select(*[F.col(x).alias(f"{x}_{s}") for x in ("c", "size", "weight", "radius", "v")]) for s in "ab")
        apart = F.acos(F.greatest(F.lit(-1.0), F.least("cos", F.lit(1.0))))
        both = pairs.join(a, pairs.a == F.col("c_a")).join(b, pairs.b == F.col("c_b"))
        both = both.select("a", "b", "size_a", "size_b", "weight_a", "weight_b", "radius_a", "radius_b", cosine_of("v_a", "v_b").alias("cos"))
        single = (F.col("size_a") == 1) & (F.col("size_b") == 1)
        possible = F.when(single, F.col("cos") >= self.cosine).otherwise(apart <= self.angle + F.col("radius_a") + F.col("radius_b") + MARGIN)
        both = cut(both.filter((F.col("cos") > -2) & possible), "close-balls")
        # of two balls of one vector, which is its centre, each has the other's copies
        settled = both.filter(single)
        out = settled.select(F.col("a").alias("u"), F.col("b").alias("c"), F.col("weight_b").alias("n")).unionByName(
            settled.select(F.col("b").alias("u"), F.col("a").alias("c"), F.col("weight_a").alias("n"))
        )
        rest = both.filter(~single)
        sides = rest.select(F.col("a").alias("x"), F.col("b").alias("c")).unionByName(rest.select(F.col("b").alias("x"), F.col("a").alias("c")))
        members = balls.select("u", F.col("c").alias("x")).join(v, "u")
        asked = sides.join(members, "x").join(centre.withColumnRenamed("v", "w"), "c").select("u", "c", "size", "weight", "radius", cosine_of("v", "w").alias("cos"))
        asked = asked.withColumn("verdict", F.when(F.col("size") == 1, F.when(F.col("cos") >= self.cosine, 1).otherwise(0)).when(apart + F.col("radius") <= self.angle - MARGIN, 1).when(apart - F.col("radius") > self.angle + MARGIN, 0).otherwise(2))
        asked = cut(asked.select("u", "c", "weight", "verdict").filter("verdict > 0"), "vector-balls")
        sure = asked.filter("verdict = 1").select("u", "c", F.col("weight").alias("n"))
        open_ = asked.filter("verdict = 2").select("u", "c").join(balls.select(F.col("u").alias("y"), "c"), "c")
        left, right = v, vectors.select(F.col("u").alias("y"), F.col("v").alias("w"), "copies")
        compared = open_.join(left, "u").join(right, "y").select("u", "c", "copies", cosine_of("v", "w").alias("cos")).filter(F.col("cos") >= self.cosine)
        return cut(out.unionByName(sure).unionByName(compared.groupBy("u", "c").agg(F.sum("copies").alias("n"))), "links")

    def __call__(self, table: DataFrame) -> DataFrame:
        ship(table)
        rows, vectors = self.distinct(table)
        codes = self.codes(vectors)
        coded = self.coded(vectors, codes)
        balls = self.balls(vectors, coded, codes)
        members = balls.join(vectors.select("u", "first", "copies"), "u")
        summed = members.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("weight"), F.max("r").alias("radius"), F.min("first").alias("first"))
        sizes = cut(summed, "ball-sizes")
        pairs = self.ball_pairs(coded, balls, sizes, codes)
        links = self.links(vectors, balls, sizes, pairs)
        between = links.join(balls.select("u", F.col("c").alias("x")), "u").select(F.greatest("x", "c").alias("u"), F.least("x", "c").alias("v")).distinct()
        roots = components(between)
        named = sizes.join(roots, sizes.c == roots.node, "left").select("c", "weight", "first", F.coalesce("root", "c").alias("root"))
        groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = named.join(groups, "root").select("c", "weight", "component_id")
        outside = links.groupBy("u").agg(F.sum("n").alias("n"))
        found = balls.join(named, "c").join(outside, "u", "left").select("u", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
        found = cut(found.join(vectors.select("u", "v"), "u").drop("u"), "found")
        out = rows.join(found, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def hamming(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total

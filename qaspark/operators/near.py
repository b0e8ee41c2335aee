"""Near duplicates without a model: questions by their words, vectors by their angle."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from qaspark.llm.itq import WORD, Codes, EmbeddingNearDuplicates, hamming
from qaspark.operators.base import require
from qaspark.session import cut, distil

# Fixed value: tables in which vectors look for the centre of a ball.
BALL_TABLES = 8


def connected(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of all nodes of ``links`` (``a``, ``b``): the smallest node that can be reached.

    Each round hangs every node and its larger neighbours below the smallest one around, so paths halve; a round moves two rows
    a link, is written, and tells the driver one number.
    """
    spark = links.sparkSession
    edges = distil(spark, lambda: links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = cut(up.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct(), "edges")
        low = up.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        down = up.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = cut(down, "edges")
        # done when every node names one other and no named node names another
        names = edges.select("a").groupBy("a").count()
        again = edges.join(names.filter("count > 1"), "a", "left_semi").unionByName(edges.join(names.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))
        if again.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@dataclass(frozen=True)
class NearQuestions:
    """Rows whose word sets are alike: ``n_near`` other rows with a Jaccard similarity of ``similarity`` or more, and the ``first`` row of the group.

    Equal sets are one set with copies. The words of a set are ordered by how rare they are. Two similar sets share one of their
    rarest words, early enough to leave room for the rest of the overlap, and differ little in size; pairs that meet that way are
    compared whole. Words are parts between white space in lower case; rows without a word have no near row and are their own first.
    ``keys`` tell rows apart; rows equal in all of them count as one.
    """

    keys: Sequence[str]
    text: str = "question"
    similarity: float = 0.8

    def __post_init__(self) -> None:
        require(0 < self.similarity <= 1, "similarity must be above 0 and at most 1")

    def words(self) -> Column:
        parts = F.split(F.lower(F.coalesce(F.col(self.text), F.lit(""))), r"\s+")
        return F.array_sort(F.array_distinct(F.filter(parts, lambda w: w != "")))

    def sets(self, rows: DataFrame) -> DataFrame:
        """(``s``, ``words``, ``copies``, ``first``): the different word sets."""
        unique = rows.filter(F.size("words") > 0).groupBy("words").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first"))
        return cut(unique.select(F.monotonically_increasing_id().alias("s"), "*"), "word-sets")

    def prefixes(self, sets: DataFrame) -> DataFrame:
        """(``word``, ``pos``, ``s``, ``n``): the rarest words of each set."""
        each = sets.select("s", F.explode("words").alias("word"))
        # over a written table AQE can split the partition of a word that most sets hold
        counts = cut(each.groupBy("word").agg(F.count(F.lit(1)).alias("k")), "word-counts")
        ranked = each.join(counts, "word").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("ranked"))
        n = F.size("ranked")
        rare = F.slice("ranked", F.lit(1), n - F.ceil(n * self.similarity - 1e-9).cast("int") + 1)
        placed = ranked.select("s", n.alias("n"), F.posexplode(F.transform(rare, lambda r: r["word"])).alias("pos", "word"))
        return cut(placed, "rare-words")

    def links(self, sets: DataFrame) -> DataFrame:
        """(``a``, ``b``), a < b: the pairs of similar sets."""
        t = self.similarity
        rare = self.prefixes(sets)
        left = rare.select("word", *[F.col(c).alias(f"{c}_l") for c in ("pos", "s", "n")])
        sized = F.least("n", "n_l") + 1e-9 >= F.greatest("n", "n_l") * t
        room = F.least(F.col("n_l") - F.col("pos_l"), F.col("n") - F.col("pos")) + 1e-9 >= (F.col("n_l") + F.col("n")) * (t / (1 + t))
        met = left.join(rare, "word").filter((F.col("s_l") < F.col("s")) & sized & room).select(F.col("s_l").alias("a"), F.col("s").alias("b")).distinct()
        both = met.join(sets.select(F.col("s").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("words").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return cut(both.filter(shared + 1e-9 >= (F.size("x") + F.size("y") - shared) * t).select("a", "b"), "similar-sets")

    def __call__(self, df: DataFrame) -> DataFrame:
        rows = cut(df.select(F.struct(*self.keys).alias("row"), self.words().alias("words")).distinct(), "questions")
        sets = self.sets(rows)
        links = self.links(sets)
        near, first = group_by_links(sets, links, "s")
        found = sets.join(near, "s", "left").join(first, "s").select("words", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"), F.col("group_first").alias("first"))
        out = rows.join(cut(found, "near-questions"), "words", "left")
        return out.select("row.*", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.coalesce("first", "row").alias("first"))


def group_by_links(items: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """For items (``name``, ``copies``, ``first``): the copies linked to each (``n``), and the first of each group (``group_first``)."""
    copies = items.select(F.col(name).alias("b"), "copies")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(copies, "b").groupBy(F.col("a").alias(name)).agg(F.sum("copies").alias("n"))
    roots = connected(links)
    named = items.join(roots, items[name] == roots.node, "left").select(F.col(name), "first", F.coalesce("root", name).alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("group_first"))
    return near, named.join(firsts, "root").select(name, "group_first")


@dataclass(frozen=True)
class Planes(Codes):
    """Independent random planes for every length, which follow from the shape alone. Two words of bits tell most strangers apart."""

    @property
    def bits(self) -> int:
        return min(self.blocks * self.width, 2 * WORD)

    def projection(self, dims: int) -> np.ndarray:
        if dims not in self.learnt:
            self.learnt[dims] = np.random.default_rng([dims, self.blocks, self.width]).standard_normal((dims, self.blocks * self.width))
        return self.learnt[dims]


@dataclass(frozen=True)
class VectorBalls(EmbeddingNearDuplicates):
    """The balls of ``op13`` over tables of ``near``'s shape, in which equal keys meet."""

    near: NearVectors | None = None

    def codes(self, vectors: DataFrame) -> Codes:
        width, count = self.near.shape(vectors.count())
        codes = Planes(count, width, 0, {})
        return replace(codes, radius=self.near.radius(codes.bits))

    def balls(self, vectors: DataFrame, coded: DataFrame, codes: Codes) -> DataFrame:
        """Vectors of one ball share many keys, so some tables are enough to find its centre."""
        return super().balls(vectors, coded.withColumn("blocks", F.slice("blocks", 1, BALL_TABLES)), codes)

    def filed(self, coded: DataFrame, balls: DataFrame, sizes: DataFrame, codes: Codes) -> DataFrame:
        """(``t``, ``key``, ``c``, ``w0``, ..., ``slack``): the balls of every place, with the codes of their centres."""
        words = [c for c in coded.columns if c.startswith("w")]
        place = F.posexplode("blocks").alias("t", "key")
        slack = F.ceil(F.col("radius") / math.pi * codes.bits * 1.5).cast("int") + 2
        many = sizes.filter("size > 1").select("c", slack.alias("slack"))
        # a vector that is a ball by itself has its own keys; those of other members are joined to their centre's code
        alone = balls.join(many, "c", "left_anti").join(coded, "u").select("c", *words, "blocks").select(place, "c", *words, F.lit(0).alias("slack"))
        centres = many.join(coded.select(F.col("u").alias("c"), *words), "c")
        keys = balls.join(many.select("c"), "c", "left_semi").join(coded.select("u", "blocks"), "u").select("c", place).distinct()
        return alone.unionByName(cut(keys.join(centres, "c"), "tables"))

    def ball_pairs(self, coded: DataFrame, balls: DataFrame, sizes: DataFrame, codes: Codes) -> DataFrame:
        words = [c for c in coded.columns if c.startswith("w")]
        filed, place, crowd = self.filed(coded, balls, sizes, codes), ["t", "key"], self.near.crowd
        # buckets of many balls are few; they are known before anything is joined
        parts = filed.groupBy(*place).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd)
        parts = cut(parts.select(*place, F.ceil(F.col("k") / crowd).cast("int").alias("parts")), "crowded")
        # both sides are named alike, so that one exchange serves them
        left, right = (filed.select(*[F.col(x).alias(f"{x}_{s}") for x in filed.columns]) for s in "ab")
        same = (F.col("t_a") == F.col("t_b")) & (F.col("key_a") == F.col("key_b"))
        if not parts.isEmpty():
            n = F.coalesce("parts", F.lit(1))
            left = left.join(parts.toDF("t_a", "key_a", "parts"), ["t_a", "key_a"], "left").withColumn("part_a", F.explode(F.sequence(F.lit(0), n - 1)))
            right = right.join(parts.toDF("t_b", "key_b", "parts"), ["t_b", "key_b"], "left").withColumn("part_b", F.pmod(F.xxhash64("c_b"), n).cast("int"))
            same = same & (F.col("part_a") == F.col("part_b"))
        apart = hamming([F.col(f"{w}_a") for w in words], [F.col(f"{w}_b") for w in words])
        met = left.join(right, same & (F.col("c_a") < F.col("c_b")) & (apart <= codes.radius + F.col("slack_a") + F.col("slack_b")))
        return cut(met.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "ball-pairs")


@dataclass(frozen=True)
class NearVectors:
    """Vectors at a cosine of ``cosine`` or more: ``n_near`` other rows, and the smallest id of the group as ``first``.

    Signatures are signs of products with random planes, whose numbers follow from a seed, so no table of planes is shipped. They
    are cut into tables; two vectors are compared where they have the same key in a table and their first bits differ in at most
    ``radius``. A vector goes into each table once: asking for keys one bit off takes fewer tables and many times the rows. Width grows with the number of rows and the number of tables with the width, so that a pair at the threshold is
    missed with a probability of at most ``miss`` (by the independence of planes), whatever the size. Equal vectors are one. Vectors
    that lie within half the threshold's angle of one other are a ball, all near one another, so a dense group is never listed in
    pairs: balls meet in the tables, and vectors of two balls are compared singly only where the angles of the balls leave it open
    (``EmbeddingNearDuplicates``). A bucket of more than ``crowd`` balls is cut into parts that meet in as many tasks. Null, empty,
    zero and non-finite vectors, and vectors of different lengths, are never near.
    Input ``id`` column and ``vector`` column; rows equal in both count as one.
    """

    id: str = "vec_id"
    vector: str = "embedding"
    cosine: float = 0.95
    miss: float = 1e-4
    crowd: int = 2000

    @property
    def differ(self) -> float:
        """The probability that one plane parts two vectors at the threshold."""
        return math.acos(self.cosine) / math.pi

    def shape(self, rows: int) -> tuple[int, int]:
        """Width of a table in bits, and number of tables."""
        width = min(28, max(8, math.ceil(math.log2(max(2, rows)))))
        return width, math.ceil(math.log(self.miss / 2) / math.log(1 - (1 - self.differ) ** width))

    def radius(self, bits: int) -> int:
        """The fewest bits that a pair at the threshold exceeds with a probability of at most half of ``miss``."""
        q, beyond, r = self.differ, 1 - (1 - self.differ) ** bits, 0
        while beyond > self.miss / 2:
            r += 1
            beyond -= math.comb(bits, r) * q**r * (1 - q) ** (bits - r)
        return r

    def __call__(self, df: DataFrame) -> DataFrame:
        v = F.transform(self.vector, lambda x: x.cast("double"))
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        rows = df.select(F.col(self.id).alias("vec_id"), v.alias("v"))
        usable = (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
        rows = cut(rows.select("vec_id", F.when(usable, F.col("v")).alias("embedding")).distinct(), "vector-rows")
        found = VectorBalls(cosine=self.cosine, near=self)(rows)
        return found.select(F.col("vec_id").alias(self.id), F.col("n_links").alias("n_near"), F.col("component_id").alias("first"))

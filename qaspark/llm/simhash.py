"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has one bit for each bit of a shingle hash: the majority over all shingles. ``CoveringLsh`` finds
every pair of fingerprints that differ in at most two bits. Its masks are structured: bit i of the fingerprint has
a non-zero vector m(i) of three bits, and table v (v = 1..7) keeps the bits with odd <m(i), v>. Two differing bits
give two linear equations over three unknowns, so some v is orthogonal to both and that table keeps neither: the
pair collides there, always.

Colliding fingerprints are linked without listing pairs. In a bucket all members agree on the kept bits; each
member names the points at distance one or less among the free bits. Two members differ in at most two bits
exactly when they name a common point, and a point has at most 65 members, so each point links its members to
the smallest of them. Work is linear in a bucket's size, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import keyed, row_id, ship
from qaspark.session import cut, distil, drop_tables, scratch

BITS = 64
SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_tables(radius: int = 2) -> list[int]:
    """Unsigned masks of the 2^(radius+1) - 1 covering tables."""
    vectors = (1 << (radius + 1)) - 1
    own = [1 + i % vectors for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (own[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; fewer words give one shingle, none gives none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([hash_of(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts.tolist(), ends[k - 1 :].tolist())
    return np.array([hash_of(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint; zero for no shingle."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(k: int):
    """Pandas UDF: text to signed fingerprint. Only the text travels to Python."""

    @F.pandas_udf("bigint")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(majority(shingle_hashes(t or "", k))) for t in texts], dtype="int64")

    return fingerprint


@dataclass(frozen=True)
class CoveringLsh:
    """Links every two of the distinct fingerprints in ``fp`` that differ in at most two bits."""

    def links(self, prints: DataFrame) -> DataFrame:
        """``prints``: a column ``fp``. Returns (``u``, ``v``), u > v: stars that connect exactly what links."""
        masks = mask_tables(2)
        free = [[0] + [signed(1 << i) for i in range(BITS) if not mask >> i & 1] for mask in masks]
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
        members = prints.select("fp").select("fp", F.inline(tables))
        crowded = members.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").drop("lo", "hi")
        flips = F.element_at(F.array(*[F.array(*[F.lit(b) for b in row]) for row in free]), F.col("t") + 1)
        points = members.join(crowded, ["t", "key"]).select("fp", F.explode(flips).alias("bit"))
        # a point has at most 65 fingerprints within one bit, so the set is bounded
        balls = points.groupBy(F.expr("fp ^ bit").alias("point")).agg(F.collect_set("fp").alias("near")).filter("size(near) > 1")
        return (
            balls.select(F.array_min("near").alias("v"), F.explode("near").alias("u"))
            .filter("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``): the smallest node reachable from every linked node.

    Alternating large and small stars; each round is written to the shared folder, and only two numbers a round
    reach the driver. Ends when a round changes nothing.
    """
    spark = links.sparkSession
    with scratch() as used:
        edges = cut(links.select("u", "v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, used = used, []
        with scratch() as used:
            edges = cut(small, "links")
        drop_tables(spark, before)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            edges = distil(spark, lambda: edges, "links")
            drop_tables(spark, used)
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark


@dataclass(frozen=True)
class SimHashDedup:
    """Fingerprints and classes of whole documents.

    Input columns ``doc_id`` and ``text``; others are ignored. Null texts count as empty and get fingerprint zero,
    which links like any other. Texts of any length are read whole. Repeated rows and ties share a fingerprint and so a class. A null id belongs to its
    class but never names it unless all its ids are null. An empty table gives no rows.
    Returns ``doc_id``, ``fp`` (signed), ``component_id`` (smallest id reachable).
    """

    shingle: int = 3

    def __call__(self, docs: DataFrame) -> DataFrame:
        ship(docs)
        rows = docs.select("doc_id", fingerprint_column(self.shingle)("text").alias("fp"))
        rows = cut(rows, "fingerprints")
        firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
        roots = cut(components(CoveringLsh().links(firsts)), "roots")
        linked = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = cut(linked.join(names, "root").select("fp", "component_id"), "classes")
        return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def hex_of(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# --- near copies by similarity ----------------------------------------------------------------------


def _anchored(texts: pd.Series, k: int, seeds: np.ndarray, width: int) -> Iterator[tuple]:
    """For each text the fingerprints of its anchored windows and the number of its different shingles."""
    for text in texts:
        hashes = shingle_hashes(text or "", k)
        if not len(hashes):
            yield [], 0
            continue
        prints = []
        for seed in seeds:
            mixed = (hashes ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            at = int(np.argmin(mixed ^ (mixed >> np.uint64(29))))
            prints.append(signed(majority(hashes[at : at + width])))
        yield prints, len(np.unique(hashes))


def shingle_bits(own: np.ndarray, limit: int = 1 << 16) -> bytes:
    """A bitmap of different shingle hashes by their low bits: about four bits a shingle, at least 64 and at most ``limit``."""
    size = min(limit, max(64, 1 << (4 * len(own) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def similarity_bound(n: int, left: bytes, m: int, right: bytes) -> float:
    """The largest Jaccard similarity that sets of ``n`` and ``m`` shingles with these bitmaps can have.

    A bit that only one side has stands for at least one shingle that only that side has. The longer bitmap is folded.
    """
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = int(np.bitwise_count(x & y).sum())
    shared = min(n - int(np.bitwise_count(x).sum()) + both, m - int(np.bitwise_count(y).sum()) + both)
    return shared / max(1, n + m - shared)


@dataclass(frozen=True)
class NearDuplicates:
    """Groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    A fingerprint of a whole document cannot serve this threshold: at similarity 0.8 about ten of 64 bits differ,
    and covering tables for ten bits number 2047. So each document has ``anchors`` fingerprints of short windows:
    for each of several hash orders the window starts at the document's smallest shingle. Two documents of
    similarity s choose the same shingle with probability s in every order, so all orders fail with probability
    (1 - s)^anchors; the covering tables also join windows in which a bit or two differ. In a class of linked
    windows each document is compared with the smallest of the class and the smallest of its salt in the class,
    linear in the class. Members of one class that are then in different groups meet by a prefix filter: two similar
    documents share one of their rarest shingles (``prefixes``), early enough that what follows can still reach the
    threshold. In a block of one such shingle first all meet the block's most central document. Then blocks hold balls
    instead of documents: a document and all that are linked to it. The Jaccard distance obeys the triangle inequality, so
    two balls whose centres are further apart than the threshold and both radii have no link, and a large group meets a
    document once. Only members of balls that are close enough, at distances that allow it, are compared in pairs. So no two
    similar documents of one class stay apart, and the exact similarity of whole shingle sets decides every link. Groups
    are told apart by a 64-bit hash of their name.

    The texts of all documents that share a class with another are written once, and no later step goes back to the table. A
    pair's texts meet only where bitmaps of the two shingle sets leave the similarity possible; the bound errs on one side only.

    Input ``doc_id``, ``text``; other columns are ignored. Null and wordless texts are never near copies. Repeated
    rows are one document. Ties do not occur: the order is by id (null as zero), then by a hash of the text. Texts of any length are
    taken whole. An empty table gives no links and keeps nothing.
    """

    similarity: float = 0.8
    shingle: int = 5
    anchors: int = 8
    width: int = 3
    salts: int = 16
    sample: int = 5000
    known: int = 1 << 18

    def sketches(self, docs: DataFrame) -> DataFrame:
        ship(docs)
        k, width = self.shingle, self.width
        seeds = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(self.anchors)], np.uint64)

        @F.pandas_udf("prints array<bigint>, n int")
        def sketch(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(list(_anchored(texts, k, seeds, width)), columns=["prints", "n"])

        rows = keyed(docs).select(F.struct("_r1", "_r2").alias("doc"), sketch("text").alias("s"))
        return cut(rows.select("doc", "s.prints", "s.n"), "sketches")

    def classes(self, rows: DataFrame) -> DataFrame:
        """(``c``, ``doc``, ``n``): the classes of linked windows that each document shares with another."""
        windows = rows.select("doc", "n", F.explode(F.array_distinct("prints")).alias("fp"))
        roots = cut(components(CoveringLsh().links(windows.select("fp").distinct())), "roots")
        every = cut(windows.join(roots, windows.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("c"), "doc", "n"), "window-classes")
        shared = every.groupBy("c").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("c")
        return cut(every.join(cut(shared, "shared-classes"), "c", "left_semi"), "shared-window-classes")

    def texts(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(``doc``, ``text``, ``n``, ``bits``): each document of ``classes`` once, with the number and the bitmap of its shingles."""
        k = self.shingle

        @F.pandas_udf("n int, bits binary")
        def outline(texts: pd.Series) -> pd.DataFrame:
            sets = [np.unique(shingle_hashes(t, k)) for t in texts]
            return pd.DataFrame([(len(own), shingle_bits(own)) for own in sets], columns=["n", "bits"])

        named = keyed(docs).select(F.struct("_r1", "_r2").alias("doc"), "text")
        own = named.join(classes.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
        return cut(own.select("doc", "text", outline("text").alias("s")).select("doc", "text", "s.n", "s.bits"), "class-texts")

    def _sized(self, n: str, m: str):
        return F.least(n, m) >= F.greatest(n, m) * self.similarity

    def centres(self, classes: DataFrame) -> DataFrame:
        """(``a``, ``b``): each document with the first of its classes and of its salt in them."""
        classes = classes.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(self.salts)))
        least = F.min(F.struct("doc", "n")).alias("first")
        by_salt = classes.groupBy("c", "salt").agg(least, F.max("doc").alias("last"))
        by_class = by_salt.groupBy("c").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first.doc < last")
        one = classes.join(cut(by_class, "class-centres"), "c")
        two = classes.join(cut(by_salt.filter("first.doc < last"), "salt-centres"), ["c", "salt"])
        fits = (F.col("doc") > F.col("first.doc")) & self._sized("n", "first.n")
        pairs = [x.filter(fits).select(F.col("first.doc").alias("a"), F.col("doc").alias("b")) for x in (one, two)]
        return cut(pairs[0].unionByName(pairs[1]).distinct(), "centre-pairs")

    def mixed(self, classes: DataFrame, links: DataFrame) -> DataFrame:
        """(``id``, ``doc``, ``label``): documents of classes whose members are not yet all in one group."""
        groups = cut(components(links), "groups")
        marked = classes.join(groups, classes.doc == groups.node, "left").select("c", "doc", F.xxhash64(F.coalesce("root", "doc")).alias("label"))
        marked = cut(marked, "marked-classes")
        open_ = cut(marked.groupBy("c").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("c"), "open-classes")
        found = marked.join(open_, "c", "left_semi").select("doc", "label").distinct()
        return cut(found.select(F.monotonically_increasing_id().alias("id"), "doc", "label"), "open-documents")

    def prefixes(self, texts: DataFrame, members: DataFrame) -> DataFrame:
        """(``token``, ``pos``, ``id``, ``n``, ``label``, ``weight``): the rarest shingles of every member, by one order for all.

        Two sets of similarity t share t of the larger one, so with n shingles each the first n - tn + 1 of both in any
        common order meet. The order is by the count in a sample of documents, then by hash: the sample decides only
        how large blocks get, never what is found. ``weight`` is the mean count of those shingles: documents that many
        others were copied from have the largest.
        """
        k, least = self.shingle, self.similarity
        spark = texts.sparkSession
        texts = cut(texts.select("doc", "text").join(members, "doc").dropDuplicates(["id"]).select("id", "label", "text"), "open-texts")
        share = max(1, texts.count() // self.sample)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sets = [np.unique(shingle_hashes(t, k)) for t in batch["text"]]
                seen, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pd.DataFrame({"token": seen.view(np.int64), "times": times})

        sampled = texts.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("text").mapInPandas(count, "token bigint, times bigint")
        often = sampled.groupBy("token").agg(F.sum("times").alias("times")).filter("times > 2").orderBy(F.desc("times"), "token").limit(self.known).toArrow()
        keys, times = np.asarray(often["token"].to_numpy(), np.int64), np.asarray(often["times"].to_numpy(), np.int64)
        at = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[at], times[at]))

        @F.pandas_udf("tokens array<bigint>, n int, weight double")
        def rarest(texts: pd.Series) -> pd.DataFrame:
            known, counts = shared.value
            out = []
            for text in texts:
                own = np.unique(shingle_hashes(text, k)).view(np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[place] == own, counts[place], 0)
                need = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                first = np.lexsort((own, rank))[:need]
                out.append((own[first], len(own), float(rank[first].mean()) if len(first) else 0.0))
            return pd.DataFrame(out, columns=["tokens", "n", "weight"])

        rows = texts.select("id", "label", rarest("text").alias("s"))
        return cut(rows.select(F.posexplode("s.tokens").alias("pos", "token"), "id", "s.n", "s.weight", "label"), "prefixes")

    def open_blocks(self, index: DataFrame) -> DataFrame:
        """``index`` without the blocks of one group. Groups only grow, so such a block never has two of them later."""
        groups = index.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        return index.join(cut(groups.filter("lo <> hi").select("token"), "open-tokens"), "token", "left_semi")

    def block_centres(self, index: DataFrame) -> DataFrame:
        """(``i``, ``j``): each document with the most central of its blocks where the two are in different groups."""
        central = F.max(F.struct("weight", (-F.col("id")).alias("less"), "id", "n", "label")).alias("f")
        firsts = index.groupBy("token").agg(central, F.min("label").alias("lo"), F.max("label").alias("hi"))
        firsts = cut(firsts.filter("lo <> hi").select("token", "f"), "block-centres")
        pairs = index.join(firsts, "token").filter((F.col("f.label") != F.col("label")) & self._sized("n", "f.n"))
        return pairs.select(F.col("f.id").alias("i"), F.col("id").alias("j")).distinct()

    def balls(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """(``id``, ``doc``, ``label``, ``c``, ``away``, ``radius``): the centre of each member's ball, its distance from it, the ball's radius."""
        groups = cut(components(links), "groups")
        label = F.xxhash64(F.coalesce("root", "doc")).alias("label")
        marked = members.select("id", "doc").join(groups, members.doc == groups.node, "left").select("id", "doc", label)
        least = links.groupBy("u").agg(F.min(F.struct("v", "s")).alias("m"))
        placed = marked.join(least, marked.doc == least.u, "left")
        placed = cut(placed.select("id", "doc", "label", F.coalesce("m.v", "doc").alias("c"), (1 - F.coalesce("m.s", F.lit(1.0))).alias("away")), "placed")
        shapes = cut(placed.groupBy("c").agg(F.max("away").alias("radius")), "shapes")
        return cut(placed.join(shapes, "c").select("id", "doc", "label", "c", "away", "radius"), "balls")

    def ball_pairs(self, index: DataFrame, balls: DataFrame) -> DataFrame:
        """(``a``, ``b``, ``need``): centres of balls of different groups that meet in a block, and the similarity below which no link is possible."""
        rows = index.select("token", "pos", "id", "n").join(balls.select("id", "label", "c", "radius"), "id")
        held = rows.groupBy("token", "c").agg(*[f("n").alias(x) for x, f in (("lo", F.min), ("hi", F.max))], F.min("pos").alias("pos"), F.first("label").alias("label"), F.first("radius").alias("radius"))
        held = cut(held, "block-balls")
        mixed = cut(held.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token"), "open-blocks")
        held = cut(held.join(mixed, "token", "left_semi"), "open-block-balls")
        left = held.select("token", *[F.col(x).alias(f"{x}_l") for x in ("c", "lo", "hi", "pos", "label", "radius")])
        t = self.similarity
        sized = (F.col("hi") >= F.col("lo_l") * t) & (F.col("hi_l") >= F.col("lo") * t)
        enough = self._enough(F.least(F.col("hi_l") - F.col("pos_l"), F.col("hi") - F.col("pos")), F.col("lo_l") + F.col("lo"))
        met = left.join(held, "token").filter((F.col("c_l") < F.col("c")) & (F.col("label_l") != F.col("label")) & sized & enough)
        met = met.select(F.col("c_l").alias("a"), F.col("c").alias("b"), (t - F.col("radius_l") - F.col("radius")).alias("need"))
        return met.distinct()

    def ball_links(self, texts: DataFrame, index: DataFrame, balls: DataFrame, pairs: DataFrame) -> DataFrame:
        """(``u``, ``v``, ``s``): the links between members of the balls in ``pairs``."""
        close = cut(self.verified(texts, pairs), "close-balls").select(F.col("v").alias("a"), F.col("u").alias("b"), "s", "need")
        settled = close.filter(F.col("need") >= self.similarity).select(F.col("b").alias("u"), F.col("a").alias("v"), "s")
        # members meet in their blocks, at distances from the centres and with sizes and places that allow a link
        open_ = close.filter(F.col("need") < self.similarity).select("a", "b", "s")
        rows = index.select("token", "pos", "id", "n").join(balls.select("id", "doc", "c", "away"), "id").drop("id")
        side = lambda x: rows.select("token", *[F.col(y).alias(f"{y}_{x}") for y in ("pos", "n", "doc", "away", "c")])
        both = open_.join(side("b"), F.col("b") == F.col("c_b")).join(side("a").withColumnRenamed("c_a", "a"), ["a", "token"])
        both = both.filter(self._sized("n_a", "n_b") & self._enough(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")), F.col("n_a") + F.col("n_b")))
        both = both.filter(F.col("away_a") + F.col("away_b") + 1e-9 >= self.similarity - F.col("s"))
        inner = both.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()
        return settled.unionByName(self.verified(texts, cut(inner, "member-pairs")).select("u", "v", "s"))

    def _enough(self, rest, sizes):
        """Whether the overlap of two similar sets fits behind the first shingle that they share."""
        return rest + 1e-9 >= sizes * (self.similarity / (1 + self.similarity))

    def links(self, docs: DataFrame) -> DataFrame:
        """(``u``, ``v``, ``s``), u > v: verified links between row names that connect all members of each group."""
        spark = docs.sparkSession
        classes = distil(spark, lambda: self.classes(self.sketches(docs)), "classes")
        texts = self.texts(docs, classes)
        found = distil(spark, lambda: self.verified(texts, self.centres(classes)).select("u", "v", "s"), "centre-links")
        members = distil(spark, lambda: self.mixed(classes, found), "members")
        if members.isEmpty():
            return found
        index = distil(spark, lambda: self.open_blocks(self.prefixes(texts, members)), "index")
        names = members.select("id", "doc")

        def central() -> DataFrame:
            pairs = self.block_centres(index).join(names.toDF("i", "x"), "i").join(names.toDF("j", "y"), "j")
            pairs = cut(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "block-pairs")
            return found.unionByName(self.verified(texts, pairs).select("u", "v", "s")).distinct()

        more = distil(spark, central, "links-so-far")
        balls = distil(spark, lambda: self.balls(members, more), "balls")
        pairs = distil(spark, lambda: self.ball_pairs(index, balls), "ball-pairs")
        return more.unionByName(distil(spark, lambda: self.ball_links(texts, index, balls, pairs), "ball-links"))

    def possible(self, texts: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those ``pairs`` (``a``, ``b``, ``need``) whose bitmaps allow the similarity ``need``."""

        @F.pandas_udf("double")
        def bound(n: pd.Series, left: pd.Series, m: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series([similarity_bound(*x) for x in zip(n, left, m, right)], dtype="float64")

        outlines = texts.select("doc", "n", "bits")
        both = pairs.join(outlines.toDF("b", "nb", "bb"), "b").join(outlines.toDF("a", "na", "ba"), "a")
        most = bound.asNondeterministic()("na", "ba", "nb", "bb").alias("most")
        return cut(both.select("a", "b", "need", most).filter(F.col("most") + 1e-12 >= F.col("need")).drop("most"), "possible-pairs")

    def verified(self, texts: DataFrame, pairs: DataFrame) -> DataFrame:
        """(``u``, ``v``, ``s``, ``need``) of those ``pairs`` (``a``, ``b``) whose whole shingle sets are as similar as ``need``, the threshold if it is absent."""
        if "need" not in pairs.columns:
            pairs = pairs.withColumn("need", F.lit(self.similarity))
        pairs = self.possible(texts, pairs)
        involved = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        # only texts of candidates travel
        texts = cut(texts.select("doc", "text").join(involved, "doc", "left_semi"), "candidate-texts")
        k = self.shingle

        @F.pandas_udf("double")
        def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
            out, known, last = [], None, np.empty(0, np.uint64)
            for a, b in zip(left, right):
                if a != known:
                    known, last = a, np.unique(shingle_hashes(a, k))
                other = np.unique(shingle_hashes(b, k))
                shared = len(np.intersect1d(last, other, assume_unique=True))
                out.append(shared / max(1, len(last) + len(other) - shared))
            return pd.Series(out, dtype="float64")

        # the last join leaves the pairs of one centre together
        both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
        measured = both.select(F.col("b").alias("u"), F.col("a").alias("v"), similarity.asNondeterministic()("ta", "tb").alias("s"), "need")
        return measured.filter(F.col("s") + 1e-12 >= F.col("need"))

    def dropped(self, docs: DataFrame) -> DataFrame:
        """Row names that are near copies of a smaller one: every member of a group but its first."""
        rows = distil(docs.sparkSession, lambda: self.links(docs), "near-links")
        return components(rows).filter("node <> root").select("node._r1", "node._r2").distinct()

    def keep_first(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its own columns, one document of each group; repeated rows count as one."""
        named = docs.withColumns(dict(zip(("_r1", "_r2"), row_id())))
        return named.join(distil(docs.sparkSession, lambda: self.dropped(docs), "near-copies"), ["_r1", "_r2"], "left_anti").select(*docs.columns)

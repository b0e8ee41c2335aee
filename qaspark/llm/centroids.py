"""Clusters of vectors around centroids, with the nearest centroid found by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value there. For a vector the lists are walked outward from the
vector's own value, all dimensions in step. A centroid that turns up for the first time gets its exact distance. What is
still unseen lies, in every dimension, at least as far away as the list's next entry, so the sum of these frontier
distances bounds all unseen centroids from below. The walk ends when it strictly exceeds the best exact distance: at
equality an unseen centroid with a smaller number could still tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import ship
from qaspark.session import cut

EDGE = 1 << 27  # squared distances of 64 such components fit a long
UNKNOWN = np.iinfo(np.int64).max


class SortedLists:
    """The centroids of one round, sorted in every dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance, for each row."""
        k, dims = self.centroids.shape
        rows = len(vectors)
        best = np.full(rows, UNKNOWN, np.int64)
        owner = np.full(rows, k, np.int64)
        seen = np.zeros((rows, k), bool)
        # in every dimension the next entry below and above the vector's value
        above = np.stack([np.searchsorted(self.values[:, d], vectors[:, d]) for d in range(dims)], axis=1)
        below = above - 1
        open_ = np.arange(rows)
        columns = np.arange(dims)
        # a list that is left on one side goes on at the other; none ends before all centroids are seen
        while len(open_):
            x = vectors[open_]
            lo, hi = below[open_], above[open_]
            down = np.where(lo >= 0, x - self.values[np.maximum(lo, 0), columns], UNKNOWN)
            up = np.where(hi < k, self.values[np.minimum(hi, k - 1), columns] - x, UNKNOWN)
            turn = down <= up
            entry = self.order[np.where(turn, np.maximum(lo, 0), np.minimum(hi, k - 1)), columns]
            frontier = np.minimum(down, up)
            fresh = np.zeros((len(open_), k), bool)
            fresh[np.arange(len(open_))[:, None], entry] = True
            fresh &= ~seen[open_]
            # entries at the frontier itself are not yet seen, so the bound is taken before they count
            bound = (frontier * frontier).sum(axis=1)
            going = bound <= best[open_]
            fresh &= going[:, None]
            at, number = np.nonzero(fresh)
            gap = x[at] - self.centroids[number]
            exact = (gap * gap).sum(axis=1)
            # numbers ascend for each row, so the first of equal distances has the smallest
            for j in range(k):
                mine = number == j
                who, far = open_[at[mine]], exact[mine]
                better = (far < best[who]) | ((far == best[who]) & (j < owner[who]))
                best[who[better]], owner[who[better]] = far[better], j
            seen[open_] |= fresh
            below[open_] = np.where(turn, lo - 1, lo)
            above[open_] = np.where(turn, hi, hi + 1)
            open_ = open_[going & ~seen[open_].all(axis=1)]
        return owner, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


@dataclass(frozen=True)
class CentroidClusters:
    """Rounds of assignment and exact integer means over all vectors.

    Kept are vectors with exactly ``dims`` components, none null or non-finite; each component x becomes floor(``scale`` * x) as a
    whole number, held within 2^27 either way so that every distance fits a long. Centroids 0, 1, ... start as the ``k`` kept
    vectors with the smallest SHA-256 of ``<seed>:<vec_id>``, in that order; fewer vectors give fewer centroids. In each of ``rounds``
    rounds every vector goes to its nearest centroid (ties: smaller number) and every centroid that got any becomes the
    componentwise floor of their mean. A last assignment follows.

    Input ``vec_id``, ``embedding``; other columns are ignored. Repeated rows are vectors of their own and get equal answers; among
    rows that share an id the start is drawn in the order of the components. A null id hashes as the empty string.
    An empty table, or one without a kept vector, gives no rows. Sums beyond a long give null.
    Returns ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Driver and tasks hold the centroids and their sorted lists (``k`` times ``dims`` numbers); a task adds up its vectors first,
    so a round shuffles ``k`` rows a task and sends ``k`` rows to the driver.
    """

    k: int = 8
    dims: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: int = 3

    def vectors(self, table: DataFrame) -> DataFrame:
        """(``vec_id``, ``v``): the kept vectors in whole numbers."""
        fits = (F.size("embedding") == self.dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        held = lambda x: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(x.cast("double") * self.scale).cast("bigint"))).cast("int")
        return cut(table.filter(fits).select("vec_id", F.transform("embedding", held).alias("v")), "vectors")

    def start(self, vectors: DataFrame) -> np.ndarray:
        name = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(self.k).collect()
        return np.array([r["v"] for r in first], np.int64).reshape(-1, self.dims)

    def means(self, vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """The centroids after one round."""
        dims = self.dims

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = SortedLists(centroids)
            sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                x = _matrix(batch.column("v"), dims)
                if len(x):
                    owner, _ = lists.nearest(x)
                    for j in range(len(sums)):
                        sums[j] += x[owner == j].sum(axis=0)
                    counts += np.bincount(owner, minlength=len(counts))
            got = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(list(sums[got]), pa.list_(pa.int64())), pa.array(counts[got])], ["cluster", "sums", "n"])

        parts = vectors.select("v").mapInArrow(add, "cluster bigint, sums array<bigint>, n bigint")
        # whole numbers without a limit: a task's sums fit a long, those of all tasks may not
        wide = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        out = centroids.copy()
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
            out[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dims)]
        return out

    def assigned(self, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
        """(``vec_id``, ``cluster``, ``distance``) of every vector."""
        dims = self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = SortedLists(centroids)
            for batch in batches:
                x = _matrix(batch.column("v"), dims)
                owner, far = lists.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(owner, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

        kind = vectors.schema["vec_id"].dataType.simpleString()
        return cut(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"), "assigned")

    def __call__(self, table: DataFrame) -> DataFrame:
        ship(table)
        vectors = self.vectors(table)
        centroids = self.start(vectors)
        for _ in range(self.rounds if len(centroids) else 0):
            centroids = self.means(vectors, centroids)
        assigned = self.assigned(vectors, centroids)
        parts = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()
        long = lambda x: int(x) if x <= UNKNOWN else None
        total = sum(r["part"] for r in parts)
        rows = [(r["cluster"], long(r["part"]), long(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in parts]
        side = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        # one row for each of k centroids
        return assigned.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

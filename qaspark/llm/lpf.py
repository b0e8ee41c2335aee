"""Repeated byte passages by longest previous factors in suffix order.

A passage is a string of ``limit`` bytes. Two equal passages have the same smallest inner gram at the same place, so
each start of a passage belongs to one anchor, and only starts whose anchors share a gram can be equal. Anchors whose
gram is unique are done; anchors whose whole surroundings (the bytes of all their passages) are equal are repeated
as a whole. The rest, different surroundings of one gram, are sorted: the passages of an anchor class in suffix
order, with longest common prefixes, previous and next smaller positions, and from them the longest previous
factor of each start. A gram with too many different surroundings for one task is settled by hashing its single
passages, which a hot gram spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import ROW, keyed, ship
from qaspark.session import cut

GRAM = 64
PLACE = np.uint64((1 << 20) - 1)
CHUNK = 1 << 19
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position, by doubling."""
    h, width = _BYTE[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, limit: int) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first start, last start) of every anchor of a text.

    The anchor of the passage at s is the first smallest gram in it. Starts with one anchor are consecutive.
    """
    data = np.frombuffer(text, np.uint8)
    n, span = len(data) - limit + 1, limit - GRAM + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    hashes = gram_hashes(data)
    own = np.empty(n, np.int64)
    for at in range(0, n, CHUNK):
        end = min(at + CHUNK, n)
        low = hashes[at : end + span - 1]
        least = low & ~PLACE | np.arange(len(low), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: end - at], least[span - width : span - width + end - at])
        own[at:end] = (least & PLACE).astype(np.int64) + at
    first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return hashes[own[first]], own[first], first, last


def nearest_smaller(values: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place the common prefix with the nearest place before it that has a smaller value; 0 if none.

    Pointers jump over what is larger; the prefix with a farther place is the least on the way.
    """
    n = len(values)
    pointer = np.arange(n) - 1
    prefix = np.concatenate(([0], lcp)).astype(np.int64)
    todo = np.arange(n)
    while True:
        to = pointer[todo]
        todo = todo[(to >= 0) & (values[to] > values[todo])]
        if not len(todo):
            break
        via = pointer[todo]
        prefix[todo] = np.minimum(prefix[todo], prefix[via])
        pointer[todo] = pointer[via]
    prefix[pointer < 0] = 0
    return prefix


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each start, from the suffix order (ranks of starts) and its common prefixes.

    The best earlier match of a suffix is at the previous or the next place in suffix order with a smaller position.
    """
    before = nearest_smaller(order, lcp)
    after = nearest_smaller(order[::-1], lcp[::-1])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def repeated_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (in position order) equal an earlier row, and which a later one; prefixes count up to the width."""
    n, limit = windows.shape
    strings = np.ascontiguousarray(windows).view(f"S{limit}").ravel()
    order = np.argsort(strings, kind="stable")
    inside = strings[order[1:]] == strings[order[:-1]]
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    involved = np.concatenate(([False], inside)) | np.concatenate((inside, [False]))
    if involved.any():
        some = np.flatnonzero(involved)
        chain = order[some]
        lcp = np.where(np.diff(some) == 1, inside[np.minimum(some[:-1], n - 2)], False) * limit
        rank = np.argsort(np.argsort(chain))
        earlier[np.sort(chain)] = longest_previous_factors(rank, lcp) >= limit
        later[np.sort(chain)[::-1]] = longest_previous_factors(len(rank) - 1 - rank, lcp) >= limit
    return earlier, later


def repeated_starts(contexts: list[bytes], owned: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each context (in position order) the owned starts with an earlier and with a later match.

    ``owned``: offset of the first start from the anchor, and number of starts. Passages of one class start equally
    far from their anchor; only those can be equal.
    """
    sizes = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marks = [(np.zeros(k, bool), np.zeros(k, bool)) for _, k in owned.tolist()]
    steps = np.arange(limit)
    for offset in range(int(owned[:, 0].max()), int((owned[:, 0] - owned[:, 1]).min()), -1):
        inner = owned[:, 0] - offset
        here = np.flatnonzero((inner >= 0) & (inner < owned[:, 1]))
        if len(here) < 2:
            continue
        earlier, later = repeated_windows(flat[(base[here] + inner[here])[:, None] + steps])
        for i in np.flatnonzero(earlier | later).tolist():
            c = here[i]
            marks[c][0][inner[c]], marks[c][1][inner[c]] = earlier[i], later[i]
    return marks


def runs(marks: np.ndarray, at: int) -> list[tuple[int, int]]:
    """Marked places as ranges [first, last], shifted by ``at``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [(a + at, b - 1 + at) for a, b in edges.reshape(-1, 2).tolist()]


RANGES = "_r1 bigint, _r2 bigint, lo int, hi int"


@dataclass(frozen=True)
class RepeatedPassages:
    """Removes bytes covered by a passage of ``limit`` bytes that starts anywhere else as well.

    ``keep="none"`` removes every copy; ``keep="first"`` removes later copies only (order: id, text hash, position).
    Input ``doc_id``, ``text``; other columns are ignored. Null texts count as empty; texts shorter than ``limit``
    lose nothing; matches never cross documents. Repeated rows are copies of each other and get the same answer
    (with ``keep="first"`` too, since nothing orders them); null ids are one id. Texts of any length are searched whole. Judged
    on the input, never on what is left. An empty table gives no rows.
    Returns ``doc_id``, ``n_bytes``, ``spans`` (removed byte ranges [first, end)) and ``kept`` (remaining bytes).
    """

    limit: int = 400
    keep: str = "none"
    block: int = 3000
    large: int = 3000

    def anchored(self, rows: DataFrame) -> DataFrame:
        """For each row the arrays of its anchors; ``c`` hashes all bytes of an anchor's passages."""
        limit = self.limit

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r1, r2, text in zip(batch["_r1"], batch["_r2"], batch["text"]):
                    data = text.encode("utf-8", "surrogatepass")
                    h, place, lo, hi = anchors(data, limit)
                    if len(h):
                        c = [xxhash.xxh3_64_intdigest(data[a : b + limit], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist())]
                        out.append((r1, r2, h.view(np.int64), np.array(c, np.uint64).view(np.int64), place, lo, hi))
                yield pd.DataFrame(out, columns=["_r1", "_r2", "h", "c", "p", "lo", "hi"])

        arrays = ", ".join(f"{x} array<{t}>" for x, t in (("h", "bigint"), ("c", "bigint"), ("p", "int"), ("lo", "int"), ("hi", "int")))
        return rows.filter(F.octet_length("text") >= limit).select("_r1", "_r2", "text").mapInPandas(scan, f"_r1 bigint, _r2 bigint, {arrays}")

    def ranges(self, rows: DataFrame) -> DataFrame:
        """Ranges of starts of repeated passages, by row name."""
        found = cut(self.anchored(rows), "anchors")
        each = found.select(*ROW, F.inline(F.arrays_zip("h", "c", "p", "lo", "hi")))
        kinds = each.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "p", "lo", "hi")).alias("first"))
        kinds = cut(kinds, "surroundings")
        contested = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "contested")
        whole = each.join(cut(kinds.filter("n > 1").select("h", "c", "first"), "repeated"), ["h", "c"])
        if self.keep == "first":
            whole = whole.filter(F.struct(*ROW, "p", "lo", "hi") != F.col("first"))
        whole = whole.select(*ROW, "lo", "hi")

        rivals = kinds.join(contested, "h").select("h", "c", "n", "m", "first.*")
        wanted = rivals.groupBy(*ROW).agg(F.collect_list(F.struct("h", "c", "n", "m", "p", "lo", "hi")).alias("spans"))
        # the join shuffles the texts; substring cuts the bytes without leaving the JVM
        contexts = rows.select(*ROW, F.col("text").cast("binary").alias("data")).join(wanted, list(ROW)).select(*ROW, "data", F.inline("spans"))
        contexts = cut(contexts.withColumn("data", F.expr(f"substring(data, lo + 1, hi - lo + {self.limit})")), "contexts")
        small, big = contexts.filter(F.col("m") <= self.large), contexts.filter(F.col("m") > self.large)
        return whole.unionByName(self.by_factors(small)).unionByName(self.by_hashes(big))

    def by_factors(self, contexts: DataFrame) -> DataFrame:
        """Suffix order and longest previous factors of whole grams, some thousand contexts at a time."""
        limit, block, none = self.limit, self.block, self.keep == "none"

        def settle(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates(["h", "c"]).sort_values(["_r1", "_r2", "lo"], ignore_index=True)
            owned = np.column_stack((rows["p"] - rows["lo"], rows["hi"] - rows["lo"] + 1))
            out = []
            marks = repeated_starts(rows["data"].tolist(), owned, limit)
            for r1, r2, lo, (earlier, later) in zip(rows["_r1"], rows["_r2"], rows["lo"], marks):
                out += [(r1, r2, a, b) for a, b in runs(earlier | later if none else earlier, lo)]
            return pd.DataFrame(out, columns=["_r1", "_r2", "lo", "hi"])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = []
            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= block:
                    rows = pd.concat(held, ignore_index=True)
                    done = rows["h"] != rows["h"].iloc[-1]  # the last gram may go on
                    if done.any():
                        yield settle(rows[done])
                    held = [rows[~done]]
            rows = pd.concat(held, ignore_index=True) if held else None
            if rows is not None and len(rows):
                yield settle(rows)

        sorted_by_gram = contexts.select("h", "c", *ROW, "p", "lo", "hi", "data").repartition("h").sortWithinPartitions("h")
        return sorted_by_gram.mapInPandas(scan, RANGES)

    def by_hashes(self, contexts: DataFrame) -> DataFrame:
        """Single passages of hot grams, counted by their hash with partial sums."""
        limit = self.limit

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r1, r2, lo, hi, data in zip(batch["_r1"], batch["_r2"], batch["lo"], batch["hi"], batch["data"]):
                    digests = [xxhash.xxh3_128_digest(data[i : i + limit]) for i in range(hi - lo + 1)]
                    parts = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"_r1": r1, "_r2": r2, "lo": np.arange(lo, hi + 1, dtype=np.int32), "a": parts[:, 0], "b": parts[:, 1]})

        windows = contexts.dropDuplicates(["h", "c"]).select(*ROW, "lo", "hi", "data").mapInPandas(scan, "_r1 bigint, _r2 bigint, lo int, a bigint, b bigint")
        windows = cut(windows, "hot-passages")
        shared = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "lo")).alias("first")).filter("n > 1").drop("n")
        found = windows.join(cut(shared, "hot-repeats"), ["a", "b"])
        if self.keep == "first":
            found = found.filter(F.struct(*ROW, "lo") != F.col("first"))
        return found.select(*ROW, "lo", F.col("lo").alias("hi"))

    def __call__(self, docs: DataFrame) -> DataFrame:
        ship(docs)
        rows = keyed(docs)
        limit = self.limit

        @F.pandas_udf("spans array<struct<first:int,end:int>>, kept binary")
        def remove(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
            out = []
            for text, found in zip(texts, ranges):
                data = text.encode("utf-8", "surrogatepass")
                spans = _merged(found, limit) if found is not None else []
                kept, at = [], 0
                for first, end in spans:
                    kept.append(data[at:first])
                    at = end
                out.append(([{"first": a, "end": b} for a, b in spans], b"".join((*kept, data[at:]))))
            return pd.DataFrame(out, columns=["spans", "kept"])

        starts = F.sort_array(F.collect_set(F.struct("lo", "hi")))
        by_row = self.ranges(rows).groupBy(*ROW).agg(starts.alias("found"))
        flat = by_row.select(*ROW, F.flatten(F.transform("found", lambda x: F.array(x["lo"], x["hi"]))).alias("found"))
        cleaned = rows.join(flat, list(ROW), "left").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), remove("text", "found").alias("r"))
        return cleaned.select("doc_id", "n_bytes", "r.spans", "r.kept")


def _merged(found: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Byte spans covered by passages, from (first start, last start) pairs in order; touching spans are one."""
    out: list[list[int]] = []
    for lo, hi in np.asarray(found).reshape(-1, 2).tolist():
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + limit)
        else:
            out.append([lo, hi + limit])
    return [tuple(x) for x in out]

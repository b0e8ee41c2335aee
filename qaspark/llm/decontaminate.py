"""Benchmark passages inside documents: SimHash of item-sized windows, block index, exact similarity.

Only windows that share a shingle with the benchmark can be similar to an item, so fingerprints are taken around
shared shingles; all others have similarity zero. A window of an item's length gets a SimHash fingerprint, the
block index returns every item whose fingerprint is within the radius, and the exact weighted similarity of the
shingle counts (sum of minima over sum of maxima) decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import blocks, keyed, row_id, ship
from qaspark.session import cut

WORD = re.compile(r"[^\W_]+")
CACHE = 400_000
BLOCK_BITS = 8
FOUND = "unnamed boolean, _r1 bigint, _r2 bigint, item_id bigint, start bigint, n_words bigint, differing int, similarity double"
_words: dict[str, tuple[int, ...]] = {}


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words: letters and digits only, lower case. A bounded cache keeps what white space delimits."""
    pieces = text.split()
    missing = set(pieces).difference(_words)
    if missing:
        if len(_words) > CACHE:
            _words.clear()
            missing = set(pieces)
        for piece in missing:
            _words[piece] = tuple(xxhash.xxh64_intdigest(w) for w in WORD.findall(piece.lower()))
    return np.fromiter((h for hashes in map(_words.__getitem__, pieces) for h in hashes), np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every ``size`` shingles in a row, from running sums of bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    ones = total[size:] - total[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


class BlockIndex:
    """All stored fingerprints within ``radius`` bits.

    64 bits are eight blocks. If at most ``radius`` bits differ, some block differs in at most radius // 8 bits, so
    each fingerprint is filed in every block under all values that near. Each look-up is one table row a block.
    """

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        near = [[v for v in range(256) if (v ^ x).bit_count() <= radius // 8] for x in range(256)]
        self.tables = []
        for b in range(8):
            filed = defaultdict(list)
            for i, p in enumerate(prints.tolist()):
                for v in near[p >> (b * BLOCK_BITS) & 255]:
                    filed[v].append(i)
            sizes = np.array([len(filed[v]) for v in range(256)])
            self.tables.append((np.concatenate(([0], np.cumsum(sizes))), np.array([i for v in range(256) for i in filed[v]], np.int64)))

    def __call__(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, stored, differing bits) of every pair within the radius."""
        pairs = []
        for b, (starts, items) in enumerate(self.tables):
            value = (prints >> np.uint64(b * BLOCK_BITS) & np.uint64(255)).astype(np.int64)
            counts = starts[value + 1] - starts[value]
            query = np.repeat(np.arange(len(prints)), counts)
            within = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
            pairs.append(query * len(self.prints) + items[np.repeat(starts[value], counts) + within])
        pairs = np.unique(np.concatenate(pairs))
        query, stored = np.divmod(pairs, max(len(self.prints), 1))
        differing = np.bitwise_count(prints[query] ^ self.prints[stored]).astype(np.int64)
        near = differing <= self.radius
        return query[near], stored[near], differing[near]


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = a.keys() | b.keys()
    return sum(min(a[x], b[x]) for x in both) / max(1, sum(max(a[x], b[x]) for x in both))


class BenchmarkIndex:
    """The items of one block of the benchmark, by number of words."""

    def __init__(self, items: list[tuple], k: int, radius: int, similarity: float) -> None:
        self.similarity = similarity
        self.sizes: dict[int, dict] = {}
        by_size = defaultdict(list)
        for item_id, text in items:
            words = word_hashes(text or "")
            if len(words):
                by_size[len(words)].append((item_id, shingles(words, min(k, len(words)))))
        for n, own in by_size.items():
            m = min(k, n)
            prints = np.concatenate([window_prints(h, len(h)) for _, h in own])
            known = np.unique(np.concatenate([h for _, h in own]))
            self.sizes[n] = {"k": m, "ids": [i for i, _ in own], "counts": [Counter(h.tolist()) for _, h in own], "index": BlockIndex(prints, radius), "known": known}
        self.known = {m: np.unique(np.concatenate([s["known"] for s in self.sizes.values() if s["k"] == m])) for m in {s["k"] for s in self.sizes.values()}}
        # a bit table answers most look-ups without a search
        self.marks = {m: np.zeros(1 << 20, bool) for m in self.known}
        for m, hashes in self.known.items():
            self.marks[m][hashes >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray, m: int) -> np.ndarray:
        maybe = np.flatnonzero(self.marks[m][hashes >> np.uint64(44)])
        known = self.known[m]
        place = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[place] == hashes[maybe]]

    def matches(self, text: str) -> list[tuple]:
        """(item, first word, words, differing bits, similarity): the best window of every matching item."""
        words = word_hashes(text)
        all_hashes = {m: shingles(words, m) for m in self.known}
        all_hits = {m: self.hits(h, m) for m, h in all_hashes.items()}
        best: dict = {}
        for n, own in self.sizes.items():
            hashes, hits = all_hashes[own["k"]], all_hits[own["k"]]
            # a text shorter than the item is one window; with too few shingles it cannot reach the similarity
            size = min(n - own["k"] + 1, len(hashes))
            if not len(hits) or size + 1e-9 < self.similarity * (n - own["k"] + 1):
                continue
            own_hits = hits[np.isin(hashes[hits], own["known"])]
            last = len(hashes) - size
            for low, high in _spans(own_hits, size, last):
                prints = window_prints(hashes[low : high + size], size)
                for q, i, d in zip(*(x.tolist() for x in own["index"](prints))):
                    window = hashes[low + q : low + q + size]
                    s = weighted_similarity(Counter(window.tolist()), own["counts"][i])
                    if s >= self.similarity:
                        key, found = own["ids"][i], (-s, low + q, size + own["k"] - 1, d)
                        best[key] = min(best.get(key, found), found)
        return [(key, at, n, d, -s) for key, (s, at, n, d) in best.items()]


def _spans(hits: np.ndarray, size: int, last: int) -> list[tuple[int, int]]:
    """Window starts that hold a hit, as merged ranges [low, high]."""
    out: list[list[int]] = []
    for hit in hits.tolist():
        low, high = max(0, hit - size + 1), min(hit, last)
        if low > high:
            continue
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


@dataclass(frozen=True)
class Decontamination:
    """Finds and removes documents that hold a benchmark item.

    Words are runs of letters and digits in lower case; shingles have five words (a shorter item is one shingle).
    ``radius`` bits of 64 cover a similarity of 0.8 with the usual spread of SimHash; all fingerprints within it are
    verified. Input ``doc_id``, ``text`` and the benchmark's ``item_id``, ``text``; other columns are ignored, or kept
    by ``remove``. Null, empty and wordless texts match nothing on either side. Equal items each match; repeated
    rows each give their matches, a null id like any other. The best window of an item wins, of equals the first. Texts of
    any length are searched whole; one shorter than an item is one window. The benchmark is read in blocks of
    bounded size, each a pass over the documents. An empty table on either side gives no match and removes nothing.
    """

    similarity: float = 0.8
    shingle: int = 5
    radius: int = 15

    def __call__(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        ship(docs)
        rows, found = keyed(docs), None
        for items in blocks(benchmark, "item_id"):
            part = self.scan(rows, items)
            found = part if found is None else found.unionByName(part)
        return found

    def scan(self, rows: DataFrame, items: list[tuple]) -> DataFrame:
        settings = (self.shingle, self.radius, self.similarity)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = BenchmarkIndex(items, *settings)
            for batch in batches:
                out = []
                for unnamed, text, r1, r2 in batch.itertuples(index=False):
                    out += [(unnamed, r1, r2, *m) for m in index.matches(text)] if index.sizes else []
                frame = pd.DataFrame(out, columns=["unnamed", "_r1", "_r2", "item_id", "start", "n_words", "differing", "similarity"])
                yield frame.astype({"item_id": "Int64"})

        found = rows.select(F.isnull("doc_id").alias("unnamed"), "text", "_r1", "_r2").mapInPandas(look, FOUND)
        return found.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("_r1"))).drop("unnamed")

    def remove(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """``docs`` with its own columns, without the documents that match."""
        found = cut(self(docs, benchmark).select("_r1", "_r2").distinct(), "contaminated")
        named = docs.withColumns(dict(zip(("_r1", "_r2"), row_id())))
        return named.join(found, ["_r1", "_r2"], "left_anti").select(*docs.columns)

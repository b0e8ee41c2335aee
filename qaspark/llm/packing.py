"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into groups of bounded size, and every group
is packed by several islands, each a small population in a task of its own. A gene is a whole bin. Crossover injects
well-filled bins of one parent into the other, removes the bins that now hold a piece twice, and puts displaced
pieces back by best fit, longest first. Between epochs the best packing of an island migrates to its neighbour. The
bins that stay poorly filled are opened once more and their pieces packed across groups.
"""

from __future__ import annotations

import itertools
import random
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import ship, text_of
from qaspark.session import cut

END = b"\0\0\0\0"
CACHE = 200_000
ODD_SPACES = "\x1c\x1d\x1e\x1f"
MARKS = "".join(c for c in string.punctuation if c != "'")

# --- token ids ----------------------------------------------------------------------------------------


class WordTokens:
    """Ids of a text as little-endian bytes, for a tokenizer that never joins what white space parts.

    Each stretch between white space is encoded once and kept; of a stretch that ends in ASCII marks other than the apostrophe
    the word and the marks are looked up, as the tokenizer parts them there. A full cache stays as it is: frequent
    words come early, and rare ones are not worth a place. Rare inputs that Python and the tokenizer would part differently
    are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """A word of letters only goes straight to the merges; ASCII letters are their own byte names."""
        low = word.lower()
        known = self.words.get(low)
        if known is None:
            if low.isalpha() and (low.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word)):
                pieces = self.model.tokenize(low if low.isascii() else self.bytes_of(low)[0][0])
                known = array("I", [p.id for p in pieces]).tobytes()
            else:
                return self.encode(word)
            if len(self.words) < 2 * CACHE:
                self.words[low] = known
        return known

    def mark(self, marks: str) -> bytes:
        known = self.marks.get(marks)
        if known is None:
            known = self.encode(marks)
            if len(self.marks) < CACHE:
                self.marks[marks] = known
        return known

    def stretch(self, piece: str) -> bytes:
        head = piece.rstrip(MARKS)
        if len(head) == len(piece):
            known = self.word(piece)
        elif not head or head.isalpha() and head.lower().isalpha():
            known = (self.word(head) if head else b"") + self.mark(piece[len(head) :])
        else:
            known = self.encode(piece)
        if len(self.stretches) < CACHE:
            self.stretches[piece] = known
        return known

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self.encode(text)
        known = self.stretches.get
        return b"".join([known(p) or self.stretch(p) for p in text.split()])


_tokenizers: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, with its caches."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


# --- one group ------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items`` (longest first) each where the least room remains; a new bin where none fits.

    The rooms in use are bits of one number, so the tightest fit is its lowest set bit above the length.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in items:
        size = lengths[i]
        fits = mask >> size
        if fits:
            r = (fits & -fits).bit_length() - 1 + size
            own = by_room[r]
            b = own.pop()
            if not own:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(0)
        room[b] = r = r - size
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r


@dataclass(frozen=True)
class Evolution:
    """A population of packings of one group. Lengths come longest first; a packing is a list of bins."""

    capacity: int
    population: int = 4
    generations: int = 6

    def start(self, lengths: list[int], rng: random.Random) -> list[list[list[int]]]:
        return list(self.starts(lengths, rng))

    def starts(self, lengths: list[int], rng: random.Random) -> Iterator[list[list[int]]]:
        """Best fit decreasing, then best fit in orders that are disturbed a little."""
        for k in range(self.population):
            order = list(range(len(lengths)))
            if k:
                order.sort(key=lambda i: -lengths[i] * (1 + 0.15 * rng.random()))
            bins: list[list[int]] = []
            best_fit(lengths, order, bins, [], self.capacity)
            yield bins

    def fitness(self, lengths: list[int], bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first; of equal numbers the one with the squares of fill concentrated."""
        return -len(bins), sum(sum(lengths[i] for i in b) ** 2 for b in bins)

    def cross(self, lengths: list[int], one: list[list[int]], two: list[list[int]], rng: random.Random) -> list[list[int]]:
        """Inject a random half of the well-filled bins of ``two`` into ``one``."""
        full = [b for b in two if sum(lengths[i] for i in b) >= 0.995 * self.capacity]
        injected = rng.sample(full, (len(full) + 1) // 2) if full else []
        inside = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in one:
            if inside.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in inside]
        # the emptiest bin is opened too, so that a bin can be saved
        if kept:
            worst = min(range(len(kept)), key=lambda b: sum(lengths[i] for i in kept[b]))
            displaced += kept.pop(worst)
        bins = [list(b) for b in (*injected, *kept)]
        room = [self.capacity - sum(lengths[i] for i in b) for b in bins]
        best_fit(lengths, sorted(displaced), bins, room, self.capacity)
        return bins

    def run(self, lengths: list[int], seed: int, guests: list[list[list[int]]] = ()) -> list[list[int]]:
        """The best packing after the generations, or as soon as no packing can have fewer bins."""
        bound = -(-sum(lengths) // self.capacity)
        rng = random.Random(seed)
        herd: list[list[list[int]]] = []
        for bins in itertools.chain(guests, self.starts(lengths, rng)):
            if len(bins) <= bound:
                return bins
            herd.append(bins)
        herd = sorted(herd, key=lambda b: self.fitness(lengths, b), reverse=True)[: self.population]
        for _ in range(self.generations if lengths else 0):
            if len(herd[0]) <= bound:
                break
            young = [self.cross(lengths, *rng.sample(herd, 2), rng) for _ in range(self.population)] if len(herd) > 1 else []
            herd = sorted(herd + young, key=lambda b: self.fitness(lengths, b), reverse=True)[: self.population]
        return herd[0]


def to_places(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            out[i] = b
    return out


def to_bins(places: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(places, default=-1) + 1)]
    for i, b in enumerate(places):
        out[b].append(i)
    return [b for b in out if b]


PIECE = "row string, piece int, start bigint, length bigint, ids_crc32 bigint"
ORDER = ["length", "row", "piece", "ids_crc32", "start"]


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Longest first. Rows that tie in everything are interchangeable."""
    return rows.sort_values(ORDER, ascending=[False, True, True, True, True], ignore_index=True)


@dataclass(frozen=True)
class BestFitPacking:
    """Packs all documents.

    Input ``doc_id``, ``text``; other columns are ignored. Null and empty texts are a piece of one token (the end id);
    repeated rows are packed each. Only documents longer than ``capacity`` tokens are cut. An empty table gives no
    rows. Returns a row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    """

    tokenizer: str
    capacity: int = 2048
    group: int = 4096
    islands: int = 2
    epochs: int = 2
    evolution: tuple[int, int] = (4, 6)

    def pieces(self, docs: DataFrame) -> DataFrame:
        path, capacity = self.tokenizer, self.capacity

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens = word_tokens(path)
            for batch in batches:
                out = []
                for row, text in zip(batch["row"], batch["text"]):
                    ids = tokens(text) + END
                    n = len(ids) // 4
                    for piece, at in enumerate(range(0, n, capacity)):
                        end = min(at + capacity, n)
                        out.append((row, piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
                yield pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])

        # the id travels as text (null: empty): pandas would turn a column with nulls into floats
        rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row"), text_of().alias("text"))
        return rows.mapInPandas(split, PIECE)

    def __call__(self, docs: DataFrame) -> DataFrame:
        ship(docs)
        pieces = cut(self.pieces(docs), "pieces")
        whole = self.pack(pieces, "packed")
        # what is settled stays; the pieces of poorly filled sequences meet those of other groups
        settled = whole.filter(F.col("filled") >= int(0.98 * self.capacity)).withColumn("sequence_id", F.col("sequence_id") * 2)
        loose = whole.filter(F.col("filled") < int(0.98 * self.capacity)).drop("sequence_id", "offset", "filled")
        again = self.pack(cut(loose, "loose-pieces"), "repacked").withColumn("sequence_id", F.col("sequence_id") * 2 + 1)
        named = F.when(F.col("row") != "", F.col("row")).cast("bigint").alias("doc_id")
        return settled.unionByName(again).select(named, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

    def pack(self, pieces: DataFrame, label: str) -> DataFrame:
        """One packing of written pieces, in groups of about ``group`` rows."""
        groups = max(1, -(-pieces.count() // self.group))
        # a number for each row of the written table, then hashed: equal rows are dealt like any others
        dealt = cut(pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")), f"{label}-groups")
        elites = None
        for epoch in range(self.epochs):
            elites = cut(self.epoch(dealt, elites, epoch), f"{label}-elites")
        capacity = self.capacity

        def choose(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            rows = in_order(rows)
            lengths = rows["length"].tolist()
            judge = Evolution(capacity)
            bins = max((to_bins(list(p)) for p in found["places"]), key=lambda b: judge.fitness(lengths, b), default=[])
            sequence, offset, filled = [0] * len(rows), [0] * len(rows), [0] * len(rows)
            for b, items in enumerate(bins):
                at = 0
                for i in items:
                    sequence[i], offset[i] = (int(key[0]) << 24) + b, at
                    at += lengths[i]
                for i in items:
                    filled[i] = at
            return rows.assign(sequence_id=sequence, offset=offset, filled=filled)[[c.split()[0] for c in f"{PIECE}, sequence_id, offset, filled".split(", ")]]

        packed = dealt.groupBy("g").cogroup(elites.groupBy("g")).applyInPandas(choose, f"{PIECE}, sequence_id bigint, offset bigint, filled bigint")
        return cut(packed, label)

    def epoch(self, dealt: DataFrame, elites: DataFrame | None, epoch: int) -> DataFrame:
        """(``g``, ``island``, ``places``): each island's best packing; the guest is its neighbour's last best."""
        capacity, size = self.capacity, self.evolution

        def evolve(key: tuple, rows: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
            lengths = sorted(rows["length"].tolist(), reverse=True)
            seed = (int(key[0]) << 8) + int(key[1]) * 16 + epoch
            best = Evolution(capacity, *size).run(lengths, seed, [to_bins(list(p)) for p in guests["places"]])
            return pd.DataFrame({"g": [key[0]], "island": [key[1]], "places": [to_places(best, len(lengths))]})

        islands = F.explode(F.sequence(F.lit(0), F.lit(self.islands - 1))).alias("island")
        herd = dealt.select("g", "length", islands).groupBy("g", "island")
        schema = "g int, island int, places array<int>"
        if elites is None:
            elites = dealt.sparkSession.createDataFrame([], schema)
        moved = elites.select("g", F.pmod(F.col("island") + 1, F.lit(self.islands)).alias("island"), "places")
        if self.islands > 1:
            moved = moved.unionByName(elites)
        return herd.cogroup(moved.groupBy("g", "island")).applyInPandas(evolve, schema)

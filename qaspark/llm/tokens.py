"""Token counts that follow edits.

A document keeps its pre-tokens in a tree: leaves are blocks of (characters, tokens) per pre-token, inner nodes are sums.
An edit descends to the touched pre-tokens, takes boundary context before them, parts and counts the new text only
until its boundaries fall on old ones again, and updates the sums on the way up.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from qaspark.llm.common import keyed, row_id, ship, text_of

# Fixed value: the published pre-token pattern of this byte-level vocabulary.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
CONTEXT = 3  # a pre-token is decided by at most so many characters after its end
BLOCK = 64
CACHE = 400_000


class PieceCounter:
    """Tokens of a pre-token, with a bounded cache for each worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path).model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.model.tokenize(self.bytes_of(piece)[0][0]))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = n
        return n

    def all(self, pieces: list[str]) -> list[int]:
        try:
            return [self.known[p] for p in pieces]
        except KeyError:
            return [self(p) for p in pieces]


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


class CountTree:
    """Blocks of pre-tokens under a binary tree of (characters, tokens) sums."""

    def __init__(self, sizes: list[int], counts: list[int]) -> None:
        self.blocks = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for b, (s, c) in enumerate(self.blocks):
            self.chars[self.width + b], self.tokens[self.width + b] = sum(s), sum(c)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """(block, characters before it) of the block that holds character ``at``; the last one beyond the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def update(self, block: int) -> None:
        node = self.width + block
        self.chars[node], self.tokens[node] = sum(self.blocks[block][0]), sum(self.blocks[block][1])
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def flat(self) -> tuple[list[int], list[int]]:
        return [x for s, _ in self.blocks for x in s], [x for _, c in self.blocks for x in c]


class EditedDocument:
    """A text with its count tree; ``encoded`` counts the pre-tokens that edits have encoded anew."""

    def __init__(self, text: str, count: PieceCounter, leaves: tuple[list[int], list[int]] | None = None) -> None:
        self.text, self.count, self.encoded = text, count, 0
        if leaves is None:
            pieces = PRE_TOKEN.findall(text)
            leaves = (list(map(len, pieces)), count.all(pieces))
        self.tree = CountTree(*leaves)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) of the present text; offsets are cut to it."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        tree, text = self.tree, self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        block, at = tree.find(max(0, start - CONTEXT))
        sizes, counts = tree.blocks[block]
        keep = 0
        while keep < len(sizes) and at + sizes[keep] <= start - CONTEXT:
            at += sizes[keep]
            keep += 1
        # old boundaries after the edit, block by block, until the new parting meets one
        last, old, within = block, at, keep
        fresh: list[str] = []
        here = at
        while True:
            while old < max(end, here - shift) or old < here - shift:
                if within >= len(tree.blocks[last][0]):
                    if last + 1 >= len(tree.blocks):
                        break
                    last, within = last + 1, 0
                    continue
                old += tree.blocks[last][0][within]
                within += 1
            if here - shift == old and old >= end:
                break
            found = PRE_TOKEN.match(text, here)
            if found is None:
                break
            fresh.append(found.group())
            here = found.end()
        new_counts = self.count.all(fresh)
        self.encoded += len(fresh)
        tail_sizes, tail_counts = tree.blocks[last][0][within:], tree.blocks[last][1][within:]
        tree.blocks[block] = (sizes[:keep] + list(map(len, fresh)) + (tail_sizes if last == block else []), counts[:keep] + new_counts + (tail_counts if last == block else []))
        for b in range(block + 1, last):
            tree.blocks[b] = ([], [])
        if last != block:
            tree.blocks[last] = (tail_sizes, tail_counts)
        for b in range(block, last + 1):
            tree.update(b)
        self.text = text


EDITS = "array<struct<start:int,end:int,text:string>>"


@dataclass(frozen=True)
class EditAwareCounts:
    """Counts tokens of documents and keeps the counts right under edits.

    Input ``doc_id``, ``text``; other columns are ignored unless named. Null texts count as empty (no token); repeated rows are
    counted each. Edits are applied in their order to the text as it then is; null edits, or null fields in one,
    change nothing (a null text deletes). Edits that tie in place follow their order in the list. A column named like an
    output is not carried over. Texts of any length are counted whole. An empty table gives no rows.
    """

    tokenizer: str

    def index(self, docs: DataFrame) -> DataFrame:
        """The leaves of each document's tree, to be kept beside the documents: ``_r1``, ``_r2``, ``sizes``, ``counts``, ``tokens``."""
        ship(docs)
        path = self.tokenizer

        @F.pandas_udf("sizes array<int>, counts array<int>, tokens bigint")
        def leaves(texts: pd.Series) -> pd.DataFrame:
            count, out = counter(path), []
            for text in texts:
                pieces = PRE_TOKEN.findall(text)
                counts = count.all(pieces)
                out.append((list(map(len, pieces)), counts, sum(counts)))
            return pd.DataFrame(out, columns=["sizes", "counts", "tokens"])

        return keyed(docs).select("doc_id", "_r1", "_r2", leaves("text").alias("l")).select("doc_id", "_r1", "_r2", "l.*")

    def recount(self, docs: DataFrame, edits: str, index: DataFrame | None = None, texts: bool = True) -> DataFrame:
        """``doc_id``, tokens before and after the edits in column ``edits``, what was encoded anew, and with ``texts`` the text as it then is.

        With ``index`` the kept leaves are joined by row name; without it the trees are built on the way, for the documents that
        have an edit.
        """
        ship(docs)
        path = self.tokenizer

        kinds = "before bigint, after bigint, n_edits int, pre_tokens bigint, encoded bigint" + ", text string" * texts

        def usable(e: dict | None) -> bool:
            return e is not None and not pd.isna(e["start"]) and not pd.isna(e["end"])

        @F.pandas_udf(kinds)
        def follow(bodies: pd.Series, lists: pd.Series, sizes: pd.Series, counts: pd.Series) -> pd.DataFrame:
            count, out = counter(path), []
            for text, edits, s, c in zip(bodies, lists, sizes, counts):
                todo = [e for e in edits if usable(e)] if edits is not None else []
                if not todo:
                    each = count.all(PRE_TOKEN.findall(text)) if s is None else c
                    n = int(sum(each))
                    out.append((n, n, 0, len(each), 0, text)[: 5 + texts])
                    continue
                doc = EditedDocument(text, count, None if s is None else (list(s), list(c)))
                before, pieces = doc.tree.total, sum(len(b[0]) for b in doc.tree.blocks)
                for e in todo:
                    doc.edit(int(e["start"]), int(e["end"]), e["text"] or "")
                out.append((before, doc.tree.total, len(todo), pieces, doc.encoded, doc.text)[: 5 + texts])
            return pd.DataFrame(out, columns=[k.split()[0] for k in kinds.split(", ")])

        rows = docs.select("doc_id", text_of().alias("text"), F.col(edits).cast(EDITS).alias("edits"), *row_id())
        if index is None:
            none = F.lit(None).cast("array<int>")
            rows = rows.withColumns({"sizes": none, "counts": none})
        else:
            rows = rows.join(index.select("_r1", "_r2", "sizes", "counts").dropDuplicates(["_r1", "_r2"]), ["_r1", "_r2"], "left")
        done = rows.select("doc_id", follow("text", "edits", "sizes", "counts").alias("f"))
        return done.select("doc_id", "f.*")


# Shapes of mail addresses, long numbers and keys, and runs of one mark.
PRIVATE = (
    regex.compile(r"[\w.+-]++@[\w-]+(?:\.[\w-]+)+"),
    regex.compile(r"\b[0-9A-Fa-f]{16,}\b"),
    regex.compile(r"\+?\d[\d ().-]{7,}\d"),
)
MARKS = regex.compile(r"([^\w\s])\1{2,}")


def private_spans(text: str) -> list[tuple[int, int]]:
    """The leftmost match of any shape, then the leftmost behind it; of shapes that begin together the first listed.

    Each shape is searched by itself, which an engine does far faster than it tries all of them at every character.
    """
    out, at = [], 0
    ahead = [shape.search(text) for shape in PRIVATE]
    while any(ahead):
        _, k = min((m.start(), k) for k, m in enumerate(ahead) if m)
        out.append(ahead[k].span())
        at = ahead[k].end()
        ahead = [shape.search(text, at) if m and m.start() < at else m for shape, m in zip(PRIVATE, ahead)]
    return out


def cleaning_edits(text: str) -> list[dict]:
    """Edits of a cleaning pass, each against the text as left by the ones before: private data named, marks shortened."""
    found = [(a, b, "[private]") for a, b in private_spans(text)]
    covered = [(a, b) for a, b, _ in found]
    k = 0
    for m in MARKS.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or covered[k][0] >= m.end():
            found.append((m.start(), m.end(), m.group(1)))
    out, shift = [], 0
    for a, b, new in sorted(found):
        out.append({"start": a + shift, "end": b + shift, "text": new})
        shift += len(new) - (b - a)
    return out


def cleaning_column():
    @F.pandas_udf(EDITS)
    def edits(texts: pd.Series) -> pd.Series:
        return pd.Series([cleaning_edits(t or "") for t in texts], dtype=object)

    return edits

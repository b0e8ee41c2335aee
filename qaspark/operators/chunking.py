"""Document to chunk rows. Everything runs inside the row: no shuffle, no Python worker."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions.text import WS, is_blank, let, py_strip, py_words
from qaspark.operators.base import fold_in_blocks, require

HEADING = rf"(?md)^(#{{1,6}})[{WS}]+(.+?)[{WS}]*$"
PARAGRAPH_GAP = rf"\n[{WS}]*\n"
SENTENCE_END = rf"(?<=[。！？.!?])[{WS}]*"


@dataclass(frozen=True)
class WordChunks:
    """Windows of ``chunk_words`` words every ``chunk_words - overlap_words``, up to the first that reaches the end.

    Input ``(source_md, text)``, output ``(source_md, chunk_index, chunk_text)`` and any other input columns.
    """

    chunk_words: int = 512
    overlap_words: int = 0

    def __post_init__(self) -> None:
        require(self.chunk_words > 0, "chunk_words must be positive")
        require(self.overlap_words >= 0, "overlap_words must be non-negative")
        require(self.overlap_words < self.chunk_words, "overlap_words must be smaller than chunk_words")

    def __call__(self, df: DataFrame) -> DataFrame:
        size, step = self.chunk_words, self.chunk_words - self.overlap_words
        # both columns below are read twice later on, which keeps the split from being inlined
        split = df.withColumn("_words", py_words(F.col("text")))
        counted = split.withColumn("_n", F.size("_words"))
        last = F.ceil(F.greatest(F.col("_n") - size, F.lit(0)) / F.lit(step)).cast("int")
        windows = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice("_words", i * step + 1, size), " "),
        )
        chunks = F.when(F.col("_n") > 0, windows)
        kept = [c for c in df.columns if c not in ("source_md", "text")]
        return counted.select("source_md", *kept, F.posexplode(chunks).alias("chunk_index", "chunk_text"))


def sections(text: Column) -> Column:
    """Heading sections ``array<struct<level, title, body>>``; text without a heading is one section of level 0.

    The pieces between headings and the headings themselves come from the same expression, so piece
    ``i + 1`` belongs to heading ``i``. Code fences are not looked at.
    """
    bodies = F.split(text, HEADING)
    marks = F.regexp_extract_all(text, F.lit(HEADING), 1)
    titles = F.regexp_extract_all(text, F.lit(HEADING), 2)
    headed = F.zip_with(
        marks,
        titles,
        lambda mark, title: F.struct(F.length(mark).alias("level"), py_strip(title).alias("title")),
    )
    preamble = F.struct(F.lit(0).alias("level"), F.lit("").alias("title"))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("title"), text.alias("body")))
    parts = F.zip_with(
        F.concat(F.array(preamble), headed),
        bodies,
        lambda head, body: F.struct(head.level.alias("level"), head.title.alias("title"), py_strip(body).alias("body")),
    )
    # a blank preamble is no section; a blank section below a heading is kept here
    kept = F.filter(parts, lambda s: (s.level > 0) | (s.body != ""))
    # most plain texts hold no "#" at all and skip the three pattern scans
    return F.when(~F.contains(text, F.lit("#")), whole).when(F.size(marks) == 0, whole).otherwise(kept)


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(py_strip(text), PARAGRAPH_GAP), py_strip)
    return F.filter(parts, lambda p: p != "")


def sentence_pieces(paragraph: Column) -> Column:
    """Stripped pieces after each end mark, also inside numbers."""
    parts = F.transform(F.split(paragraph, SENTENCE_END), py_strip)
    return F.filter(parts, lambda p: p != "")


def _unit(text: Column, run: Column, joint: int, sep: str) -> Column:
    return F.struct(
        text.alias("text"),
        F.length(text).alias("size"),
        run.cast("int").alias("run"),
        F.lit(joint).alias("joint"),
        F.lit(sep).alias("sep"),
    )


def _packing_units(paras: Column, max_chars: int) -> Column:
    """Paragraphs, with each oversize one replaced by its sentences under its own run number."""

    def units(p: Column, i: Column) -> Column:
        split_up = F.transform(sentence_pieces(p), lambda s: _unit(s, i, 1, ""))
        return F.when(F.length(p) > max_chars, split_up).otherwise(F.array(_unit(p, F.lit(-1), 2, "\n\n")))

    return F.flatten(F.transform(paras, units))


def pack(units: Column, max_chars: int) -> Column:
    """Greedy packing: a unit joins the open group while it fits, and never crosses a run border.

    A fold finds the last unit of every group; the texts are joined once, afterwards.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("done"), F.lit(0).alias("seen"), F.lit(0).alias("used"), F.lit(-1).alias("run")
    )

    def step(acc: Column, u: Column) -> Column:
        fresh = acc.seen == 0
        closes = ~fresh & ((u.run != acc.run) | (acc.used + u.joint + u.size > max_chars))
        return F.struct(
            F.when(closes, F.concat(acc.done, F.array(acc.seen))).otherwise(acc.done).alias("done"),
            (acc.seen + 1).alias("seen"),
            F.when(fresh | closes, u.size).otherwise(acc.used + u.joint + u.size).alias("used"),
            u.run.alias("run"),
        )

    def groups(us: Column) -> Column:
        ends = F.concat(fold_in_blocks(us, start, step).done, F.array(F.size(us)))
        spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), ends, lambda i, j: F.struct(i.alias("i"), j.alias("j")))
        texts = lambda span: F.transform(
            F.slice(us, span.i + 1, span.j - span.i), lambda u, k: F.when(k == 0, u.text).otherwise(F.concat(u.sep, u.text))
        )
        return F.transform(spans, lambda span: F.array_join(texts(span), ""))

    return let(units, lambda us: F.when(F.size(us) == 0, F.array().cast("array<string>")).otherwise(groups(us)))


def paragraph_groups(body: Column, max_chars: int) -> Column:
    """Groups of paragraphs up to ``max_chars``; a body that fits stays whole, inner blank lines included."""
    fits = F.when(py_strip(body) != "", F.array(py_strip(body))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(body) <= max_chars, fits).otherwise(
        pack(_packing_units(paragraphs(body), max_chars), max_chars)
    )


def section_prefix(level: Column, title: Column) -> Column:
    marks = F.when(level > 0, F.repeat(F.lit("#"), level)).otherwise(F.lit("##"))
    return F.when(title == "", F.lit("")).otherwise(F.concat(marks, F.lit(" "), title, F.lit("\n\n")))


@dataclass(frozen=True)
class SemanticChunks:
    """Chunks along headings and paragraphs, each with its heading put back in front.

    Sections are exploded before packing, so the fold works on one section at a time; chunks are then
    numbered by position inside the document without a shuffle.
    """

    max_chunk_chars: int = 2048
    min_chunk_chars: int = 256

    def __post_init__(self) -> None:
        require(self.max_chunk_chars > 0, "max_chunk_chars must be positive")
        require(self.min_chunk_chars >= 0, "min_chunk_chars must be non-negative")
        require(self.min_chunk_chars < self.max_chunk_chars, "min_chunk_chars must be smaller than max_chunk_chars")

    def __call__(self, df: DataFrame) -> DataFrame:
        def chunks_of(section: Column) -> Column:
            prefix = section_prefix(section.level, section.title)
            return F.transform(
                paragraph_groups(section.body, self.max_chunk_chars),
                lambda part: F.struct(
                    py_strip(F.concat(prefix, part)).alias("chunk_text"),
                    section.title.alias("section_title"),
                    section.level.alias("section_level"),
                ),
            )

        all_chunks = F.flatten(F.transform(sections(F.col("text")), chunks_of))
        long_enough = F.filter(all_chunks, lambda c: F.length(c.chunk_text) >= self.min_chunk_chars)
        kept = [c for c in df.columns if c not in ("source_md", "text")]
        return (
            df.filter(~is_blank(F.col("text")))
            .select("source_md", *kept, F.posexplode(long_enough).alias("chunk_index", "_c"))
            .select("source_md", *kept, "chunk_index", "_c.*", F.lit("semantic").alias("chunking_strategy"))
        )

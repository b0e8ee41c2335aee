"""Chunk to multi-sentence contexts: quality gate, sentences, sliding triples. No shuffle is needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qaspark.functions.text import count_char, let, py_strip, special_char_ratio, strip_bound
from qaspark.operators.base import require
from qaspark.operators.language import normalize_language

# Fixed values of the gate and the triple builder.
MIN_STOPS = 2
MAX_SPECIAL_RATIO = 0.3
MIN_SENTENCE = 3
MIN_LINK = 11
TRIPLE = 3
# Columns of a context that follow from its chunk and its number.
CONTEXT_TEXTS = ("premise", "intermediate", "conclusion", "related_contexts", "context", "supporting_sentence_count")


def context_language(language: str) -> str:
    """zh or en; every other value, ``auto`` included, means zh."""
    return language if language in ("zh", "en") else "zh"


def passes_gate(text: Column, min_length: int = 100, max_length: int = 200_000) -> Column:
    """Length within bounds, two full stops of one kind, and not too many special characters (stripped text)."""
    stops = (count_char(text, "。") >= MIN_STOPS) | (count_char(text, ".") >= MIN_STOPS)
    long_enough = F.length(text).between(min_length, max_length)
    # the ratio costs a pattern scan, so it is tried last
    return F.when(long_enough & stops, special_char_ratio(text) <= MAX_SPECIAL_RATIO).otherwise(F.lit(False))


def sentences(text: Column, language: str) -> Column:
    stop = r"\." if language == "en" else "。"
    return F.filter(F.transform(F.split(text, stop), strip_bound), lambda s: F.length(s) >= MIN_SENTENCE)


def info_pairs(sents: Column) -> Column:
    """Triples of consecutive sentences with the first two long sentences outside the leading pair."""
    # at most two long sentences are in the leading pair, so the first four always leave the two needed
    long_ones = F.slice(
        F.filter(F.transform(sents, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.length(x.s) >= MIN_LINK),
        1,
        4,
    )

    def one(i: Column, candidates: Column) -> Column:
        related = F.filter(candidates, lambda x: (x.i != i) & (x.i != i + 1))
        return F.struct(
            F.get(sents, i).alias("premise"),
            F.get(sents, i + 1).alias("intermediate"),
            F.get(sents, i + 2).alias("conclusion"),
            F.transform(F.slice(related, 1, 2), lambda x: x.s).alias("related_contexts"),
        )

    starts = F.when(F.size(sents) >= TRIPLE, F.sequence(F.lit(0), F.size(sents) - TRIPLE)).otherwise(
        F.array().cast("array<int>")
    )
    triples = let(long_ones, lambda c: F.transform(starts, lambda i: one(i, c)))
    return F.filter(
        triples, lambda p: (F.length(p.premise) >= MIN_LINK) & (F.length(p.intermediate) >= MIN_LINK)
    )


@dataclass(frozen=True)
class MultiHopContexts:
    """Context rows of chunks; ``info_pair_index`` counts the kept triples of a chunk from 0."""

    language: str = "zh"
    min_text_length: int = 100
    max_text_length: int = 200_000
    min_context_sentences: int = 3

    def __post_init__(self) -> None:
        require(self.min_context_sentences >= 2, "min_context_sentences must be at least 2")
        object.__setattr__(self, "language", context_language(self.language))
        normalize_language(self.language)

    def _split(self, df: DataFrame) -> DataFrame:
        gated = df.withColumn("_text", py_strip(F.coalesce("chunk_text", F.lit("")))).withColumn(
            "_ok", passes_gate(F.col("_text"), self.min_text_length, self.max_text_length)
        )
        # sentences are read several times by the triple builder, hence a column of their own
        return gated.withColumn(
            "_sents", F.when(F.col("_ok"), sentences(F.col("_text"), self.language))
        ).withColumn("_n", F.size("_sents"))

    def _pairs(self) -> Column:
        return F.when(F.col("_n") >= self.min_context_sentences, info_pairs(F.col("_sents")))

    def _told(self, df: DataFrame) -> DataFrame:
        sep = ". " if self.language == "en" else " "
        parts = F.filter(F.array("premise", "intermediate", "conclusion"), lambda p: p != "")
        return df.withColumns({"context": F.array_join(parts, sep), "supporting_sentence_count": F.lit(TRIPLE)})

    def __call__(self, df: DataFrame) -> DataFrame:
        each = self._split(df).select(*df.columns, F.posexplode(self._pairs()).alias("info_pair_index", "_p"))
        return self._told(each.select(*df.columns, "info_pair_index", "_p.*"))

    def again(self, df: DataFrame) -> DataFrame:
        """The columns ``CONTEXT_TEXTS`` of context rows that kept ``chunk_text`` and ``info_pair_index`` alone."""
        placed = self._split(df).select(*df.columns, F.get(self._pairs(), F.col("info_pair_index")).alias("_p"))
        return self._told(placed.select(*df.columns, "_p.*"))

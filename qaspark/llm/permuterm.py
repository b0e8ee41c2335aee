"""Spelling variants by permuterm rotations.

A word is closed with a terminator, and every rotation of the closed word is filed. Turned so that the edited character
comes last, a replacement is a prefix range: all rotations that go on from one prefix by exactly one character. The word
that lacks the character is the rotation that ends where the range begins, so insertions and deletions lie in the
same range. Rotations are sorted by prefix, each range is scanned once, and its members are one another's neighbours.

A range holds at most one word for each letter and the shorter word, so its size is bounded by the alphabet, not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from qaspark.llm.common import text_of
from qaspark.session import cut

END = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    return F.translate(run, UPPER, LOWER)


@dataclass(frozen=True)
class CorpusWords:
    """Words of whole texts with their counts, after a reproducible misspelling of one occurrence in ``every``.

    A word is a maximal run of ``letters``; only A-Z are lower-cased. An occurrence whose CRC-32 of ``<doc_id>:<run>`` is
    divisible by ``every`` loses the code point at that number modulo its length; ``every=0`` leaves all as they are.
    Words of fewer than ``least`` code points or fewer than ``seen`` occurrences are left out.

    Input ``doc_id`` and ``text``; other columns are ignored. Null and empty texts have no words, a null id is written as the
    empty string, repeated rows count again, and a text of any length is read whole. An empty table gives no rows.
    Returns ``word``, ``n``.
    """

    letters: str = "[A-Za-z\\u00C0-\\u00FF]+"
    every: int = 31
    least: int = 7
    seen: int = 2

    def __call__(self, docs: DataFrame) -> DataFrame:
        key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        runs = docs.select(key.alias("doc"), F.explode(F.regexp_extract_all(text_of(), F.lit(self.letters), 0)).alias("run"))
        runs = runs.filter(F.char_length("run") >= self.least).select("doc", lowered(F.col("run")).alias("run"))
        word = F.col("run")
        if self.every:
            mark = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
            runs = runs.select("run", mark.alias("mark"))
            at = (F.col("mark") % F.char_length("run")).cast("int")
            shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
            word = F.when(F.col("mark") % self.every == 0, shorter).otherwise(F.col("run"))
        words = runs.select(word.alias("word")).filter(F.char_length("word") >= self.least)
        return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= self.seen)


@dataclass(frozen=True)
class SpellingVariants:
    """Neighbours at one edit, the preferred form of each word and the end of its chain of forms.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form of a word is its near word
    with the largest count, ties going to the smallest in code-point order, if it is at least ``ratio`` times as frequent as
    the word; the root is reached by following forms. Counts at least double along a chain (``ratio`` > 1), so chains
    are short and never close.

    Input ``word``, ``n``; other columns are ignored. Rows of one word add up. Null and empty words, words with the
    terminator ``$`` and rows with a null count are left out. Words of any length are compared whole. An empty table gives no
    rows. Returns ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.
    """

    ratio: int = 10

    def __post_init__(self):
        if self.ratio < 2:
            raise ValueError("ratio must be 2 or more, else forms can run in circles")

    def ranges(self, words: DataFrame) -> DataFrame:
        """(``prefix``, ``last``, ``word``, ``n``): every rotation by the prefix that it shares with its neighbours.

        ``last`` is the edited character, which comes right after the prefix; it is empty for the word that lacks it.
        """
        closed = words.select("word", "n", F.concat("word", F.lit(END)).alias("closed"))
        size = F.char_length("closed")
        turned = closed.select("word", "n", "closed", F.explode(F.sequence(F.lit(1), size)).alias("at"))
        rotation = F.concat(F.substring("closed", F.col("at"), size), F.substring("closed", F.lit(1), F.col("at") - 1))
        turned = turned.select("word", "n", rotation.alias("rotation"))
        body = F.substring("rotation", F.lit(1), F.char_length("rotation") - 1)
        last = F.substring("rotation", -1, 1)
        whole = F.struct(F.col("rotation").alias("prefix"), F.lit("").alias("last"))
        # the rotation that ends with the terminator has no edited character
        both = F.when(last == END, F.array(whole)).otherwise(F.array(whole, F.struct(body.alias("prefix"), last.alias("last"))))
        return turned.select(F.inline(both), "word", "n")

    def neighbours(self, words: DataFrame) -> DataFrame:
        """(``word``, ``n_near``, ``best``): sums and the best neighbour, from one scan of the sorted ranges."""
        in_range = Window.partitionBy("prefix")
        # equal letters in a row give one word whichever is dropped: only the first of them counts
        first = F.substring("prefix", -1, 1) != F.col("last")
        member = F.struct((-F.col("n")).alias("less"), "word", "last", first.alias("first"))
        scanned = self.ranges(words).withColumn("members", F.collect_list(member).over(in_range)).filter("size(members) > 1")
        near = F.expr("filter(members, m -> m.word <> word AND CASE WHEN last = '' THEN m.first WHEN m.last = '' THEN substring(prefix, -1, 1) <> last ELSE true END)")
        found = scanned.select("word", near.alias("near")).filter("size(near) > 0")
        best = F.array_min(F.transform("near", lambda m: F.struct(m["less"].alias("less"), m["word"].alias("word"))))
        found = found.select("word", F.size("near").alias("k"), best.alias("best"))
        return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))

    def roots(self, forms: DataFrame) -> DataFrame:
        """(``word``, ``root``) of all words with a form; each round doubles the length of what is followed."""
        ends = cut(forms.select("word", F.col("form").alias("root")), "forms")
        while True:
            onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("went"))
            moved = cut(moved, "forms")
            if moved.filter("went").isEmpty():
                return moved.select("word", "root")
            ends = moved.select("word", "root")

    def __call__(self, words: DataFrame) -> DataFrame:
        usable = words.filter((F.col("word") != "") & ~F.contains("word", F.lit(END)) & F.isnotnull("n"))
        words = cut(usable.groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "words")
        near = self.neighbours(words)
        known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best")
        enough = -F.col("best.less") >= F.lit(self.ratio) * F.col("n")
        known = cut(known.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "variants")
        roots = self.roots(known.filter("form IS NOT NULL"))
        return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

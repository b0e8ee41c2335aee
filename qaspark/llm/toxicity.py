"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens get log-odds of toxic against other documents under a Dirichlet prior that follows their share of the whole
corpus. A linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa); a segment's significance
follows the extreme-value law of such scores (Karlin and Altschul), which allows for the length of the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from qaspark.llm.common import ship
from qaspark.llm.simhash import shingle_hashes
from qaspark.session import cut

WORD = re.compile(r"[^\W_]+")
STEM = range(4, 9)
CACHE = 400_000


def units(word: str) -> list[str]:
    """A word and its beginnings, longest first: a learnt stem also covers endings that training never showed."""
    return [f"{word} "] + [word[:n] for n in reversed(STEM) if n < len(word)]


class Lexicon:
    """Looks a word up by its longest known unit; a bounded cache spares the repeated look-ups."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.cache = weights, {}

    def __call__(self, word: str) -> str | None:
        try:
            return self.cache[word]
        except KeyError:
            pass
        found = next((u for u in units(word) if u in self.weights), None)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their sums, in one pass (Ruzzo and Tompa).

    Each candidate keeps the total to its left and to its right end; a new one is merged to the left with the
    nearest candidate of smaller left total whenever that one's right total does not reach its own.
    """
    total, found = 0.0, []
    for at, score in enumerate(scores):
        left, total = total, total + score
        if score <= 0:
            continue
        start, low, high = at, left, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][1] >= low:
                j = found[j][4]
            if j < 0 or found[j][2] >= high:
                found.append((start, low, high, at + 1, j))
                break
            start, low, j = found[j][0], found[j][1], found[j][4]
            del found[_first_from(found, start) :]
    return [(s, e, high - low) for s, low, high, e, _ in found]


def _first_from(found: list[tuple], start: int) -> int:
    at = len(found)
    while at and found[at - 1][0] >= start:
        at -= 1
    return at


@dataclass
class ToxicityModel:
    """Learnt weights and calibration; small, and sent to the workers whole.

    ``weights``: log-odds of the significant units, at most ``Trainer.vocabulary``. ``gap``: score of any other
    token. ``rate`` and ``size``: lambda and K of the extreme-value law. ``line``: the logistic curve.
    """

    weights: dict[str, float] = field(default_factory=dict)
    gap: float = -0.2
    rate: float = 1.0
    size: float = 0.1
    line: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def segments(self, text: str, lexicon: Lexicon) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal segments in token positions.

        Only known tokens are positive, so a stretch of others is one negative score: the scan sees the same sums.
        """
        words = WORD.findall(text.lower())
        known = [(i, u) for i, w in enumerate(words) if (u := lexicon(w)) is not None]
        scores, places, last = [], [], -1
        for i, unit in known:
            if i - last > 1:
                scores.append(self.gap * (i - last - 1))
                places.append(last + 1)
            scores.append(self.weights[unit])
            places.append(i)
            last = i
        return len(words), [(places[s], places[e - 1] + 1, v) for s, e, v in maximal_segments(scores)]

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Minus the log of the expected number of chance segments as good, and the number of significant segments.

        Segments that are significant each on their own add up; without one the best counts alone.
        """
        base = math.log(self.size * max(n, 1) + 1.0)
        single = [self.rate * v - base for _, _, v in segments]
        good = [x for x in single if x > 0]
        return (min(sum(good), 200.0) if good else max(single, default=-base)), float(len(good))

    def probability(self, evidence: float, good: float) -> float:
        a, b, c = self.line
        x = a + b * max(-20.0, min(evidence, 20.0)) + c * min(good, 3.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(x, 30.0))))


@dataclass(frozen=True)
class Trainer:
    """Learns from labelled documents.

    ``sample``: documents of each label that are used, chosen by a hash of the id; copies and near copies
    among them count once. ``odds`` and ``z``: least log-odds and
    least standard score of a unit. ``prior``: pseudo-documents of the Dirichlet prior as a share of the sample. Everything else (the prior) counts all documents. Documented bounds: ``sample``
    documents of each label, ``vocabulary`` units.
    """

    sample: int = 8000
    vocabulary: int = 20_000
    support: int = 3
    prior: float = 0.04
    z: float = 2.0
    odds: float = 3.0
    gap: float = -0.2

    def fit(self, docs: DataFrame, marks: DataFrame) -> ToxicityModel:
        """``docs``: all documents (``doc_id``, ``text``). ``marks``: ``doc_id`` and ``toxic`` of rows to learn from."""
        ship(docs)
        train = self.chosen(docs, marks)
        totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = totals.get(1, 0), totals.get(0, 0)
        if not n1 or not n0:
            return ToxicityModel(gap=self.gap, line=(-3.0 if not n1 else 3.0, 0.0, 0.0))
        y = self.unit_counts(train)
        y = {r["unit"]: (r["pos"], r["neg"]) for r in self.promising(y, n1, n0).collect()}
        corpus, everyone = self.corpus_counts(docs, list(y))
        model = ToxicityModel(weights=self.weights(y, n1, n0, corpus, everyone), gap=self.gap)
        return self.calibrated(model, train)

    def chosen(self, docs: DataFrame, marks: DataFrame) -> DataFrame:
        """At most ``sample`` documents of each label; two shingle minima that near copies share each keep one."""
        picked = None
        for label in (0, 1):
            own = marks.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(self.sample)
            picked = own if picked is None else picked.unionByName(own)
        # two narrow columns and at most two samples of rows: the size is bounded by the parameter
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

        @F.pandas_udf("one bigint, two bigint")
        def minima(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                h = shingle_hashes(t, 3)
                mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
                out.append((int(h.min() >> np.uint64(1)), int(mixed.min())) if len(h) else (0, 0))
            return pd.DataFrame(out, columns=["one", "two"])

        rows = rows.select("toxic", "text", minima("text").alias("m")).select("toxic", "text", "m.*")
        return cut(rows.dropDuplicates(["toxic", "one"]).dropDuplicates(["toxic", "two"]).select("toxic", "text"), "toxicity-sample")

    def unit_counts(self, train: DataFrame) -> DataFrame:
        """Documents of each label that hold a unit."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                seen = {0: Counter(), 1: Counter()}
                for toxic, text in zip(batch["toxic"], batch["text"]):
                    seen[int(toxic)].update({u for w in set(WORD.findall(text.lower())) for u in units(w)})
                for label, counts in seen.items():
                    if counts:
                        yield pd.DataFrame({"unit": list(counts), "pos": [n * label for n in counts.values()], "neg": [n * (1 - label) for n in counts.values()]})

        parts = train.select("toxic", "text").mapInPandas(count, "unit string, pos bigint, neg bigint")
        return parts.groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def promising(self, y: DataFrame, n1: int, n0: int) -> DataFrame:
        odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
        return y.filter(F.col("pos") >= self.support).withColumn("odds", odds).filter("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "unit").limit(self.vocabulary)

    def corpus_counts(self, docs: DataFrame, wanted: list[str]) -> tuple[dict[str, int], int]:
        """Documents of the whole corpus that hold each wanted unit (a bounded list), and their number."""
        known = dict.fromkeys(wanted, 1.0)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon, counts, n = Lexicon(known), Counter(), 0
            for batch in batches:
                for text in batch["text"]:
                    n += 1
                    found = set(map(lexicon, WORD.findall((text or "").lower())))
                    found.discard(None)
                    counts.update(found)
            yield pd.DataFrame({"unit": ["", *counts], "n": [n, *counts.values()]})

        rows = docs.select("text").mapInPandas(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect()
        counts = {r["unit"]: r["n"] for r in rows}
        return counts, counts.pop("", 0)

    def weights(self, y: dict, n1: int, n0: int, corpus: dict[str, int], everyone: int) -> dict[str, float]:
        """Log-odds with an informative Dirichlet prior; units whose z score is small are left out."""
        out, prior = {}, self.prior * (n1 + n0)
        for unit, (pos, neg) in y.items():
            alpha = prior * (corpus.get(unit, 0) + 1.0) / (everyone + 2.0)
            odds = math.log((pos + alpha) / (n1 + prior - pos - alpha + 1.0)) - math.log((neg + alpha) / (n0 + prior - neg - alpha + 1.0))
            if odds >= self.odds and odds >= self.z * math.sqrt(1.0 / (pos + alpha) + 1.0 / (neg + alpha)):
                out[unit] = odds
        return out

    def calibrated(self, model: ToxicityModel, train: DataFrame) -> ToxicityModel:
        """Lambda from the token scores of clean documents, K from their significant segments, then a logistic curve."""

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = Lexicon(model.weights)
            for batch in batches:
                out = [(int(y), *model.segments(t, lexicon)) for y, t in zip(batch["toxic"], batch["text"])]
                yield pd.DataFrame({"toxic": [y for y, _, _ in out], "n": [n for _, n, _ in out], "best": [[float(v) for _, _, v in s] for _, _, s in out]})

        rows = train.select("toxic", "text").mapInPandas(measure, "toxic int, n bigint, best array<double>").toPandas()
        clean = rows[rows["toxic"] == 0]
        chance = np.concatenate([np.asarray(b, float) for b in clean["best"]] or [np.empty(0)])
        tokens = float(clean["n"].sum())
        typical = float(np.median(list(model.weights.values()) or [1.0]))
        model.rate = _rate((len(chance) + 0.5) / (tokens + 1.0), typical, model.gap)
        model.size = float((len(chance) + 0.5) / ((tokens + 1.0) * math.exp(-model.rate * typical)))
        model.size = min(max(model.size, 1e-4), 1.0)
        seen = [model.evidence(int(n), [(0, 0, v) for v in best]) for n, best in zip(rows["n"], rows["best"])]
        x = np.array([[1.0, max(-20.0, min(e, 20.0)), min(g, 3.0)] for e, g in seen])
        model.line = tuple(_logistic(x, rows["toxic"].to_numpy(float)))
        return model


def _rate(p: float, score: float, gap: float) -> float:
    """The positive root of p e^(l score) + (1 - p) e^(l gap) = 1."""
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        value = p * math.exp(min(700.0, mid * score)) + (1 - p) * math.exp(mid * gap) - 1
        low, high = (mid, high) if value < 0 else (low, mid)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton steps for a ridge-penalised logistic curve; both labels weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score_column(model: ToxicityModel):
    """Pandas UDF: text to ``score`` and ``passages`` (token span, score, expected chance segments as good)."""
    lexicons: dict[int, Lexicon] = {}

    @F.pandas_udf("score double, passages array<struct<first:int,last:int,weight:double,expected:double>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        lexicon = lexicons.setdefault(0, Lexicon(model.weights))
        out = []
        for text in texts:
            n, segments = model.segments(text or "", lexicon)
            base = model.size * max(n, 1)
            found = [
                {"first": s, "last": e - 1, "weight": v, "expected": base * math.exp(-model.rate * v)}
                for s, e, v in segments
                if model.rate * v > math.log(base + 1.0)
            ]
            out.append((model.probability(*model.evidence(n, segments)), found))
        return pd.DataFrame(out, columns=["score", "passages"])

    return score


@dataclass(frozen=True)
class Toxicity:
    """Scores every document of a table.

    Input ``doc_id``, ``text``; ``labels``: ``doc_id``, ``toxic``. Rows whose crc32 of the id (as text, null as empty)
    leaves no remainder at ``folds`` are held out of training. Null and empty texts get the score of a text without
    tokens; null or other labels are not learnt from; rows with a null id have no label. Without both labels every
    score is the same. Repeated rows are scored alike. Other columns are kept by ``reject`` and ignored elsewhere. Texts of any
    length are scored whole; units that tie are taken in their own order. An empty table of documents gives no rows.
    """

    trainer: Trainer = field(default_factory=Trainer)
    folds: int = 5

    def held_out(self) -> Column:
        return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % self.folds == 0

    def fit(self, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        marks = labels.filter(~self.held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        return self.trainer.fit(docs, marks)

    def score(self, docs: DataFrame, model: ToxicityModel) -> DataFrame:
        ship(docs)
        scored = docs.select("doc_id", self.held_out().alias("held_out"), score_column(model)("text").alias("s"))
        return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.passages")

    def reject(self, docs: DataFrame, model: ToxicityModel) -> DataFrame:
        """``docs`` without those scored toxic; texts are not shuffled."""
        ship(docs)
        return docs.withColumn("_toxic", score_column(model)("text")["score"]).filter("_toxic < 0.5").select(*docs.columns)

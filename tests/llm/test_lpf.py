"""Repeated passages against brute force over all windows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.llm.lpf import RepeatedPassages, anchors, longest_previous_factors
from qaspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def by_hand(rows, limit=400, first=False):
    """rows: (key, text) in order. Removed bytes by key."""
    seen = defaultdict(list)
    data = [(k, (t or "").encode()) for k, t in rows]
    for n, (_, d) in enumerate(data):
        for s in range(len(d) - limit + 1):
            seen[d[s : s + limit]].append((n, s))
    gone = [np.zeros(len(d), bool) for _, d in data]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places[1 if first else 0 :]:
                gone[n][s : s + limit] = True
    return [(k, len(d), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~g])).hexdigest()) for (k, d), g in zip(data, gone)]


def answer(df):
    kept = F.octet_length("kept")
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("d"))


def test_query_against_all_windows(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    found = sorted(tuple(r) for r in QUERIES["op2_repeated_passages"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert found == by_hand([(r["doc_id"], r["text"]) for r in rows])


def planted():
    rng = np.random.default_rng(8)
    text = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    passages = [text(n) for n in (399, 400, 401, 415, 900)]
    docs = []
    for i in range(120):
        body = text(int(rng.integers(50, 700)))
        for p in passages:
            if rng.random() < 0.4:
                body += p + text(int(rng.integers(1, 300)))
        docs.append(body)
    docs += ["ab" * 900, "x" * 1500, "é" * 450, docs[0], docs[1][:-1] + "#", text(420) * 2, "", "short"]
    return list(enumerate(docs))


@pytest.mark.parametrize("settings", [{}, {"large": 10}, {"block": 7}, {"keep": "first"}, {"keep": "first", "large": 10}])
def test_planted_passages(spark, settings):
    rows = planted()
    found = RepeatedPassages(**settings)(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(tuple(r) for r in answer(found).collect()) == by_hand(rows, first=settings.get("keep") == "first")


def test_odd_rows(odd, nothing):
    rows = odd.collect()
    expected = Counter(by_hand([(r["doc_id"], r["text"]) for r in rows]))
    assert Counter(tuple(r) for r in answer(RepeatedPassages()(odd)).collect()) == expected
    assert RepeatedPassages()(nothing).count() == 0


def test_equal_passages_have_equal_anchors():
    data = bytes(np.random.default_rng(0).integers(97, 100, 3000, dtype=np.uint8))
    owner = {}
    for text, shift in ((data, 0), (b"zz" + data[100:], 98)):
        for h, p, lo, hi in zip(*(x.tolist() for x in anchors(text, 400))):
            for s in range(lo, hi + 1):
                if text[s : s + 400] in owner:
                    assert owner[text[s : s + 400]] == (h, p - s)
                owner[text[s : s + 400]] = (h, p - s)


def test_longest_previous_factors_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = "".join(rng.choice(list("ab"), 30))
        order = np.array(sorted(range(30), key=lambda i: s[i:]))
        common = lambda i, j: next((k for k in range(31) if i + k >= 30 or j + k >= 30 or s[i + k] != s[j + k]), 30)
        lcp = np.array([common(order[i], order[i + 1]) for i in range(29)])
        expected = [max((common(i, j) for j in range(i)), default=0) for i in range(30)]
        assert longest_previous_factors(order, lcp).tolist() == expected

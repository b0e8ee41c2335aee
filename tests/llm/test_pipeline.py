"""Every stage of the corpus pipeline on its own input, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from qaspark.llm.simhash import shingle_hashes
from qaspark.llm.toxicity import Toxicity
from tests.llm.test_corpus_operators import exact_by_hand, gapless, pieces_by_hand, similarity_by_hand

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that enter and leave each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.collect(), done.collect(), done.columns)
        docs = done
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        before, after, columns = stages[name]
        assert columns == COLUMNS
        assert not Counter(map(tuple, after)) - Counter(map(tuple, before))
        assert before and after


def test_toxicity(spark, stages):
    before, after, _ = stages["toxicity"]
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scorer = Toxicity()
    scores = {r["doc_id"]: r["score"] for r in scorer.score(docs, scorer.fit(docs, labels)).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if scores[r["doc_id"]] < 0.5}


def test_exact_dedup(stages):
    before, after, _ = stages["exact_dedup"]
    assert {r["doc_id"] for r in after} == {k for k, _ in exact_by_hand(before).values()}


def test_near_dedup(stages):
    before, after, _ = stages["near_dedup"]
    rows = sorted(before, key=lambda r: r["doc_id"])
    sets = [set(shingle_hashes(r["text"] or "", 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"] for r in after} == {r["doc_id"] for i, r in enumerate(rows) if find(i) == i}


def test_decontamination(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before if max(similarity_by_hand(r["text"], i)[0] for i in items) < 0.8}
    assert {r["doc_id"] for r in after} == clean


def test_packing(stages):
    before, after, _ = stages["packing"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == pieces_by_hand(before)
    gapless(after)


def test_odd_rows_through_every_stage(spark, odd, nothing, tmp_path):
    """Nulls, repeats, long texts and clashing names pass all stages; an empty table gives none."""
    labels = spark.createDataFrame([(i, 1, int(i == 3)) for i in range(14)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "never seen anywhere else at all"), (2, None)], "item_id bigint, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, nothing):
        docs = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{rows is odd}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == odd.columns
        assert (docs.count() > 0) == (rows is odd)

"""Stored layouts: what is read and rewritten, beside the rows themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from qaspark.functions.text import iso_time, utc_now
from qaspark.operators.multihop import first_by_question
from qaspark.operators.pages import PhraseIndex, ShardedItems, StoredPages
from qaspark.operators.review import item_links, upsert


def partitions_read(df):
    """Partition filters of the scans of a plan."""
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_pages_of_one_hot_and_many_small_groups(spark, tmp_path):
    rows = [("hot", i, i * 7 % 1000) for i in range(900)] + [(f"g{i % 40}", i, i) for i in range(200)] + [(None, 1, 1), (None, 2, 0)]
    frame = spark.createDataFrame(rows, "session_id string, x int, sort_index int").repartition(5)
    pages = StoredPages.write(frame, str(tmp_path / "p"), ["sort_index"], ["session_id"], rows_per_part=100)
    by_group = {}
    for s, x, k in rows:
        by_group.setdefault(s, []).append((k, x))
    for group in ("hot", "g3", None, "absent"):
        want = [x for _, x in sorted(by_group.get(group, []))]
        for limit, offset in ((10, 0), (7, 3), (50, 880), (5, 5000), (1, 1)):
            got = pages.page(limit, offset, session_id=group)
            assert [r["x"] for r in got.collect()] == want[offset : offset + limit]
        seen, at = [], -1
        while batch := pages.after(at, 333, session_id=group).collect():
            seen += [r["x"] for r in batch]
            at = batch[-1]["_at"]
        assert seen == want
    plan = pages.page(10, 500, session_id="hot")
    assert "_part" in partitions_read(plan)[0] and "Exchange hashpartitioning" not in plan._jdf.queryExecution().toString()
    whole = StoredPages.write(frame, str(tmp_path / "w"), ["session_id", "sort_index"], rows_per_part=64)
    assert [r["x"] for r in whole.page(5, 1000).collect()] == [x for _, _, x in sorted(((s or "", k, x) for s, x, k in rows))][1000:1005]
    with pytest.raises(ValueError):
        whole.page(0)


def test_pages_of_many_rows_lie_in_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("qaspark.operators.pages.MAX_PARTS", 8, raising=False)
    rows = [(f"g{i % 3}", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "session_id string, x int").repartition(3)
    pages = StoredPages.write(frame, str(tmp_path / "p"), ["x"], ["session_id"], rows_per_part=10)
    assert len(list((tmp_path / "p" / "rows").glob("_part=*"))) == 8
    want = [x for s, x in rows if s == "g1"]
    for again in (pages, StoredPages(spark, str(tmp_path / "p"), ("session_id",), 10)):
        assert [r["x"] for r in again.page(9, 120, session_id="g1").collect()] == want[120:129]
        assert [r["x"] for r in again.after(334 + 199, 40, session_id="g1").collect()] == want[200:240]
    assert "_part" in partitions_read(pages.page(10, 50, session_id="g1"))[0]


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_changes_rewrite_their_shards_only(spark, tmp_path):
    kinds = "session_id string, id string, question string, created_at bigint, updated_at bigint"
    items = spark.createDataFrame([(f"s{i % 50}", f"qa-{i}", f"q{i}", 1, 1) for i in range(600)], kinds)
    store = ShardedItems(spark, str(tmp_path / "items"), shards=16).create(items)
    before = files(tmp_path / "items")
    changes = spark.createDataFrame([("s3", "qa-3", "new", 1, 5), ("s3", "added", "x", 5, 5), ("s9", "qa-9", "old", 0, 0)], kinds)
    want = upsert(items, changes)
    read = store.current(changes)
    assert "_shard" in partitions_read(read)[0]
    store.upsert(changes)
    after = files(tmp_path / "items")
    touched = {r["_shard"] for r in changes.select(store.shard()).collect()}
    changed = {int(re.search(r"_shard=(\d+)", f).group(1)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == touched and len(touched) < 3
    assert sorted(map(tuple, store.read().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    store.replace_sessions(spark.createDataFrame([("s3", "only", "one", 9, 9)], kinds))
    rest = [tuple(r) for r in want.select("session_id", "id").collect() if r["session_id"] != "s3"] + [("s3", "only")]
    assert sorted(map(tuple, store.read().select("session_id", "id").collect())) == sorted(rest)
    store.upsert(changes.limit(0))
    assert store.read().count() == len(rest)


def test_phrases_against_plain_search(spark, tmp_path):
    rng = random.Random(3)
    words = ["the"] * 8 + ["a", "b", "c", "rare"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "The\n THE  the"), (903, "x " * 4000 + "The end")]
    index = PhraseIndex(spark, str(tmp_path / "i"), shards=8).write(spark.createDataFrame(rows, "id int, text string"), ["id"], "text")
    for phrase in ("the", "the the", "the the the", "a the b", "rare the rare", "absent", "the absent", "the end", "THE End"):
        q = phrase.lower().split()
        want = sorted((i, k) for i, t in rows for w in [(t or "").lower().split()] for k in range(len(w)) if w[k : k + len(q)] == q)
        assert sorted((r["row"]["id"], r["start"]) for r in index.search(phrase).collect()) == want
    assert all("_shard" in f for f in partitions_read(index.search("rare")))
    with pytest.raises(ValueError):
        index.search("  ")


def test_items_find_their_owners(spark):
    uploads = spark.createDataFrame([("u1",), ("u2",)], "upload_id string")
    jobs = spark.createDataFrame([("j1", "u1"), ("j2", "u2"), ("j3", "gone"), ("j4", None)], "job_id string, upload_id string")
    sessions = spark.createDataFrame([("s1", "j1"), ("s2", "j2"), ("s3", "j3"), ("s4", "none")], "session_id string, job_id string")
    items = spark.createDataFrame([("s1", i) for i in range(50)] + [("s2", 1), ("s3", 1), ("s4", 1), (None, 1)], "session_id string, id int")
    got = item_links(uploads, jobs, sessions, items)
    assert got.groupBy("upload_id", "job_id", "session_id").count().orderBy("session_id").collect() == [("u1", "j1", "s1", 50), ("u2", "j2", "s2", 1)]


def test_first_questions_stay_linear(spark):
    pairs = [{"question": f" Q{i % 7} " if i % 2 else f"q{i % 7}", "answer": str(i)} for i in range(5000)]
    frame = spark.createDataFrame([(pairs,), ([],)], "pairs array<struct<question:string,answer:string>>")
    got = frame.select(first_by_question(F.col("pairs")).alias("p")).collect()
    assert [p["answer"] for p in got[0]["p"]] == [str(i) for i in range(7)] and got[1]["p"] == []


def test_times_as_text(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-02-29 01:02:03.000400' AS a, timestamp_ntz'1999-12-31 23:59:59' AS b")
    assert tuple(rows.select(iso_time(F.col("a")), iso_time(F.col("b"))).first()) == ("2024-02-29T01:02:03.000400Z", "1999-12-31T23:59:59Z")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        from datetime import datetime, timezone

        at = spark.range(1).select(utc_now()).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert abs((datetime.fromisoformat(at) - datetime.now(timezone.utc)).total_seconds()) < 120

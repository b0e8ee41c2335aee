"""Near questions, near vectors and connected groups against plain versions of themselves."""

import math
import random

from pyspark.sql import functions as F

from qaspark.operators.near import NearQuestions, NearVectors, connected
from qaspark.session import scratch


def groups_by_hand(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {n: top(n) for n in nodes}


def test_connected_chains_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(45)] + [(500, 500), (3, 2), (3, 2)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == groups_by_hand(nodes, [x for x in links if x[0] != x[1]])
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def questions_by_hand(rows, similarity):
    sets = {k: set(w.lower() for w in (t or "").split()) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    first = groups_by_hand(sets, links)
    return {k: (sum(k in x for x in links), first[k]) for k in sets}


def test_near_questions_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "a"] * 5
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 14))]
        rows.append((i * 10, " ".join(base)))
        rows += [(i * 10 + j, " ".join(rng.sample(base, len(base)) + [rng.choice(words)][: rng.randrange(2)])) for j in (1, 2)]
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "same"), (1004, "Same  same"), (1005, "long " * 3000 + " ".join(f"x{i}" for i in range(3000)))]
    frame = spark.createDataFrame([(*r, "c") for r in rows] + [(*rows[0], "c")], "id bigint, question string, first string")
    for similarity in (0.8, 0.5, 1.0):
        got = {r["id"]: (r["n_near"], r["first"]["id"]) for r in NearQuestions(["id"], similarity=similarity)(frame).collect()}
        assert got == questions_by_hand(rows, similarity)
    assert NearQuestions(["id"])(frame.limit(0)).count() == 0


def test_rare_words_keep_a_common_word_from_pairing_all(spark):
    rows = [(i, f"what is the name of thing{i} in place{i} with part{i}") for i in range(400)]
    near = NearQuestions(["id"])
    frame = spark.createDataFrame(rows, "id bigint, question string")
    sets = near.sets(frame.select(F.struct("id").alias("row"), near.words().alias("words")))
    rare = near.prefixes(sets)
    assert rare.count() == 400 * 3 and rare.groupBy("word").count().agg(F.max("count")).first()[0] == 1
    assert near.links(sets).count() == 0


def vectors_by_hand(rows, cosine):
    unit = {}
    for k, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            high = max(map(abs, v))
            norm = math.sqrt(sum((x / high) ** 2 for x in v))
            unit[k] = [x / high / norm for x in v]
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and sum(x * y for x, y in zip(unit[a], unit[b])) >= cosine]
    first = groups_by_hand({k for k, _ in rows}, links)
    return {k: (sum(k in x for x in links), first[k]) for k, _ in rows}


def test_near_vectors_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        centre = [rng.gauss(0, 1) for _ in range(24)]
        rows += [(10 * g + j, [x + 0.25 * rng.gauss(0, 1) for x in centre]) for j in range(5)]
    hot = [rng.gauss(0, 1) for _ in range(24)]
    rows += [(1000 + j, [x + 0.1 * rng.gauss(0, 1) for x in hot]) for j in range(60)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, []), (2003, [0.0] * 24), (2004, [None] * 24), (2005, [float("nan")] * 24), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e300] * 3), (2009, [1e-300] * 3)]
    frame = spark.createDataFrame([(*r, 1) for r in rows] + [(*rows[3], 1)], "vec_id bigint, embedding array<double>, first int")
    want = vectors_by_hand(rows, 0.95)
    for crowd in (2000, 7):  # buckets of more than seven vectors meet in parts
        got = {r["vec_id"]: (r["n_near"], r["first"]) for r in NearVectors(crowd=crowd)(frame).collect()}
        assert got == want
    assert sum(n for n, _ in want.values()) > 3500
    assert NearVectors()(frame.limit(0)).count() == 0


def test_tables_hold_their_promise_at_every_size():
    for rows in (10, 10**4, 10**8, 10**12):
        width, count = NearVectors().shape(rows)
        q = math.acos(0.95) / math.pi
        assert (1 - (1 - q) ** width - width * q * (1 - q) ** (width - 1)) ** count <= 1e-4
        assert 2**width >= min(rows, 2**28)


def test_a_dense_group_of_vectors_is_not_written_as_pairs(spark):
    rng = random.Random(5)
    centre = [rng.gauss(0, 1) for _ in range(24)]
    rows = [(i, [x + 0.01 * rng.gauss(0, 1) for x in centre]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    with scratch() as paths:
        got = NearVectors()(frame).collect()
    assert {(r["n_near"], r["first"]) for r in got} == {(399, 0)} and len(got) == 400
    assert max(spark.read.parquet(p).count() for p in paths) <= 40 * len(rows)  # 79,800 pairs

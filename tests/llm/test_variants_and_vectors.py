"""Spelling variants, centroid clusters and near copies of vectors against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.llm.centroids import CentroidClusters, SortedLists
from qaspark.llm.itq import EmbeddingNearDuplicates, fit, rotation, trials, unit
from qaspark.llm.permuterm import CorpusWords, SpellingVariants
from qaspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

# --- spelling variants ----------------------------------------------------------------------------------


def words_by_hand(rows, every=31, least=7, seen=2):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= seen}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(n, ratio=10):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root)
    return out


def variants_of(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


def test_variants_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    n = words_by_hand(rows)
    kept = dict(sorted(n.items())[:1200])
    got = variants_of(SpellingVariants()(spark.createDataFrame(list(kept.items()), "word string, n bigint")))
    assert got == variants_by_hand(kept)
    found = {r["word"]: r["n"] for r in QUERIES["op11_spelling_variants"](spark, SMALL).collect()}
    assert found == n


def test_repeated_letters_ties_and_chains(spark):
    n = {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "aaaabaaa": 5000, "bookkeeper": 40, "bokkeeper": 4, "bookeeper": 4, "bookkeepr": 4, "bookkeepers": 40}
    n |= {"xbcdefg": 30, "ybcdefg": 30, "zbcdefg": 3, "ébcdefg": 3, "Ébcdefg": 3, "bcdefgx": 7}
    frame = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = variants_of(SpellingVariants()(frame))
    assert got == variants_by_hand(n)
    assert got["aaaaaaa"][4] == "aaaabaaa" and got["zbcdefg"][2] == "xbcdefg"
    assert variants_of(SpellingVariants(ratio=2)(frame)) == variants_by_hand(n, 2)
    with pytest.raises(ValueError):
        SpellingVariants(ratio=1)


def test_one_word_with_very_many_neighbours(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    n = {"abcdefgh"[:i] + c + "abcdefgh"[i + d :]: 2 + i for i in range(9) for c in letters for d in (0, 1) if i + d <= 8}
    n["abcdefgh"] = 10_000
    got = variants_of(SpellingVariants()(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert got["abcdefgh"] == (n["abcdefgh"], len(n) - 1, None, None, "abcdefgh")
    assert all(got[w][4] == "abcdefgh" for w in n)
    scan = SpellingVariants().neighbours(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    assert "CartesianProduct" not in scan._jdf.queryExecution().toString() and "Join" not in scan._jdf.queryExecution().toString()


def test_words_of_odd_documents(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for every, least, seen in ((31, 7, 2), (1, 1, 1), (0, 2, 1)):
        got = {r["word"]: r["n"] for r in CorpusWords(every=every, least=least, seen=seen)(odd).collect()}
        assert got == words_by_hand(rows, every, least, seen)
    assert CorpusWords()(nothing).count() == 0
    assert SpellingVariants()(CorpusWords()(nothing)).count() == 0
    strange = spark.createDataFrame([(None, 1, "x"), ("", 2, "x"), ("a$b", 3, "x"), ("b", 1, "y"), ("b", 1, "y"), ("c", None, "y"), ("c" * 5000, 1, "z")], "word string, n bigint, form string")
    assert variants_of(SpellingVariants()(strange)) == {"b": (2, 0, None, None, "b"), "c" * 5000: (1, 0, None, None, "c" * 5000)}


# --- centroid clusters ----------------------------------------------------------------------------------


def clusters_by_hand(rows, k=8, dims=64, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    names = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in names[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    parts = Counter()
    for _, d, j in last:
        parts[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, parts[j], sum(parts.values()), digests[j]) for i, d, j in last), key=repr)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, 2.0]), (63, [1.0, None, 1.0, 1.0]), (64, [1.0, float("nan"), 0.0, 0.0]), (65, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [rows[3], rows[3], (None, [0.5, 0.25, 0.0, -0.0001]), (66, [0.0] * 4), (67, [1e4, -1e4, 0.1, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id bigint, embedding array<double>, cluster int, distance int")
    for k, rounds in ((8, 10), (3, 2), (200, 3), (1, 1), (5, 0)):
        got = sorted(map(tuple, CentroidClusters(k=k, dims=4, rounds=rounds)(frame.repartition(5)).collect()), key=repr)
        assert got == clusters_by_hand(rows, k, 4, rounds)
    assert CentroidClusters()(frame).count() == 0
    assert CentroidClusters(dims=4)(frame.limit(0)).count() == 0


def test_threshold_walk_equals_all_distances_and_stops_early():
    rng = np.random.default_rng(0)
    for dims, k, spread in ((1, 8, 3), (2, 5, 2), (6, 20, 4), (64, 8, 500), (3, 1, 5)):
        c, x = rng.integers(-spread, spread + 1, (k, dims)), rng.integers(-spread, spread + 1, (700, dims))
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        owner, best = SortedLists(c).nearest(x)
        assert (owner == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()

    class Watched(np.ndarray):
        touched = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            Watched.touched += len(out) if isinstance(key, np.ndarray) and out.ndim == 2 else 0
            return out

    lists = SortedLists(np.arange(1000)[:, None] * 10)
    lists.centroids = lists.centroids.view(Watched)
    lists.nearest(np.arange(0, 9000, 90)[:, None] + 1)
    assert Watched.touched <= 300  # of 100,000 distances


# --- near copies of vectors -----------------------------------------------------------------------------


def links_by_hand(rows, cosine=0.95):
    """Links and components over different (id, vector) pairs."""
    usable = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[(i, tuple(v))] = unit(np.array([v], float))[0]
    keys = list(usable)
    links, parent = Counter(), {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            x, y = usable[keys[a]], usable[keys[b]]
            if len(x) == len(y) and float(x @ y) >= cosine:
                links[keys[a]] += 1
                links[keys[b]] += 1
                parent[top(keys[a])] = top(keys[b])
    first = {}
    for k in keys:
        if k[0] is not None:
            first[top(k)] = min(first.get(top(k), k[0]), k[0])
    out = []
    for i, v in rows:
        k = (i, tuple(v)) if v is not None else None
        c = first.get(top(k)) if k in usable else i
        out.append((i, links.get(k, 0), c, i == c))
    return sorted(out, key=repr)


def clouds(seed, groups, size, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return [(c / np.linalg.norm(c) + spread * rng.standard_normal(dims) / math.sqrt(dims)).tolist() for c in centres for _ in range(size)]


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.3])
def test_vector_links_against_all_pairs(spark, spread):
    vectors = clouds(5, 40, 6, 64, spread) + clouds(6, 1, 150, 64, spread)
    rows = [(3 * i + 1, v) for i, v in enumerate(vectors)]
    got = sorted(map(tuple, EmbeddingNearDuplicates()(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=repr)
    want = links_by_hand(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the threshold
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)


def test_odd_vectors(spark):
    vectors = clouds(1, 5, 4, 8, 0.1)
    rows = list(enumerate(vectors)) + [(50 + i, v) for i, v in enumerate(vectors)]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, None] + [0.0] * 6), (104, [float("nan")] + [1.0] * 7), (105, [float("inf")] + [1.0] * 7)]
    rows += [(106, [1.0]), (107, [2.0]), (108, [-1.0]), (109, [1e-300] * 8), (110, [1e300] * 8), (111, [1.0] * 8), rows[0], rows[0], (None, vectors[0]), (112, [3.0, 4.0])]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id bigint, embedding array<double>, label int, component_id int")
    got = sorted((tuple(r) for r in EmbeddingNearDuplicates()(frame).collect()), key=repr)
    assert got == links_by_hand(rows)
    assert EmbeddingNearDuplicates()(frame.limit(0)).count() == 0
    assert [tuple(r) for r in EmbeddingNearDuplicates()(frame.filter("vec_id = 100")).collect()] == [(100, 0, 100, True)]


def test_rotation_lowers_the_loss_and_keeps_lengths():
    rng = np.random.default_rng(2)
    sample = unit(rng.standard_normal((3000, 16)) * np.linspace(1, 3, 16))
    loss = lambda w: ((np.where(sample @ w >= 0, 1, -1) / 4 - sample @ w) ** 2).sum()
    turn = rotation(16, 16, 0, sample)
    assert np.allclose(turn.T @ turn, np.eye(16))
    assert loss(turn) < loss(rotation(16, 16, 0, sample, steps=0))
    x, y = trials(sample, 0.95)
    assert np.allclose((x * y).sum(axis=1), 0.95)
    for rows in (10, 100_000, 10**9):
        codes = fit(sample, rows, 0.95, 0.99)
        bits = codes.of(x) != codes.of(y)
        assert ((bits.reshape(len(x), codes.blocks, codes.width).sum(axis=2) <= 1).any(axis=1)).mean() >= 0.985


def test_hot_ball_makes_no_pairs(spark):
    """Members of one dense group are counted by their ball; rows of every written table stay linear."""
    vectors = clouds(9, 1, 600, 64, 0.08) + clouds(10, 300, 1, 64, 0.1)
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    op = EmbeddingNearDuplicates()
    rows, distinct = op.distinct(frame)
    codes = op.codes(distinct)
    coded = op.coded(distinct, codes)
    balls = op.balls(distinct, coded, codes)
    assert balls.select("c").distinct().count() < 330
    found = op(frame).agg(F.sum("n_links")).first()[0]
    assert found == 600 * 599

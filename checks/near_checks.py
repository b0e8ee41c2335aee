"""Near duplicates of questions and of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import PAIRS_SQL, check, conversation_pairs, table
from qaspark.operators.near import NearQuestions, NearVectors

_GROUPS = (
    "r AS (SELECT x AS x, x AS y FROM {items} UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y), "
    "g AS (SELECT x, min(y) AS first FROM r GROUP BY x), c AS (SELECT a, count(*) AS n FROM l GROUP BY a)"
)


@check(
    "near_questions",
    "K1",
    f"WITH RECURSIVE {PAIRS_SQL}, q AS (SELECT source_md || '#' || chunk_index AS id, question FROM qa UNION ALL SELECT source_md || '#' || chunk_index || '+', 'More: ' || question FROM qa "
    "UNION ALL SELECT source_md || '#' || chunk_index || '-', regexp_replace(question, '^\\S+\\s+', '') FROM qa), "
    "s AS (SELECT id AS x, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '')) AS w FROM q), "
    "p AS (SELECT s.x AS a, o.x AS b, len(list_intersect(s.w, o.w)) AS i, len(s.w) + len(o.w) AS n FROM s JOIN s o ON s.x <> o.x), "
    f"l AS (SELECT a, b FROM p WHERE i * 10 >= 8 * (n - i) AND i > 0), {_GROUPS.format(items='s')} "
    "SELECT g.x AS id, coalesce(n, 0) AS n_near, g.first FROM g LEFT JOIN c ON c.a = g.x",
)
def near_questions(spark, sf):
    """Questions beside their expanded forms and their forms without the first word."""
    pairs = conversation_pairs(spark, sf)
    name = F.concat("source_md", F.lit("#"), "chunk_index")
    rows = pairs.select(name.alias("id"), "question")
    longer = pairs.select(F.concat(name, F.lit("+")).alias("id"), F.concat(F.lit("More: "), "question").alias("question"))
    shorter = pairs.select(F.concat(name, F.lit("-")).alias("id"), F.regexp_replace("question", r"^\S+\s+", "").alias("question"))
    found = NearQuestions(["id"])(rows.unionByName(longer).unionByName(shorter))
    return found.select("id", "n_near", F.col("first.id").alias("first"))


@check(
    "near_vectors",
    "K5",
    "WITH RECURSIVE e AS (SELECT vec_id * 2 AS x, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), "
    "both_ AS (FROM e UNION ALL SELECT x + 1, list_transform(v, lambda y, i: y * (1 + ((x // 2 + i - 1) % 7 - 3) * 0.05)) FROM e WHERE x // 2 % 3 > 0), "
    "u AS (SELECT x, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS v FROM both_), "
    "l AS (SELECT a.x AS a, b.x AS b FROM u a JOIN u b ON a.x <> b.x WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) >= 0.95), "
    f"{_GROUPS.format(items='u')} SELECT g.x AS vec_id, coalesce(n, 0) AS n_near, g.first FROM g LEFT JOIN c ON c.a = g.x",
)
def near_vectors(spark, sf):
    """All vectors, and for two thirds of them one with every component changed a little."""
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    half = F.expr("vec_id div 2")
    moved = F.transform("embedding", lambda y, i: y * (1 + ((half + i) % 7 - 3) * 0.05))
    changed = rows.filter(half % 3 > 0).select((F.col("vec_id") + 1).alias("vec_id"), moved.alias("embedding"))
    return NearVectors()(rows.unionByName(changed))

"""Registered queries of the operators over the whole given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaspark.llm.centroids import CentroidClusters
from qaspark.llm.chat import ChatFormat
from qaspark.llm.decontaminate import Decontamination
from qaspark.llm.exact import StreamingExactDedup
from qaspark.llm.html import WrapperExtraction
from qaspark.llm.itq import EmbeddingNearDuplicates
from qaspark.llm.lines import RepeatedLines
from qaspark.llm.lpf import RepeatedPassages
from qaspark.llm.packing import BestFitPacking
from qaspark.llm.permuterm import CorpusWords, SpellingVariants
from qaspark.llm.simhash import SimHashDedup, hex_of
from qaspark.llm.tokens import EditAwareCounts, cleaning_column
from qaspark.llm.toxicity import Toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return BestFitPacking(tokenizer_path("word_bpe_49k.json"))(table(spark, sf, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scorer = Toxicity()
    return scorer.score(docs, scorer.fit(docs, table(spark, sf, "labels")))


@query("op6_decontamination")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = Decontamination()(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "differing", "similarity")


EXACT_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


@query("op9_exact_dedup", EXACT_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return StreamingExactDedup()(table(spark, sf, "documents")).drop("_r1", "_r2")


@query("op10_simhash_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = SimHashDedup()(table(spark, sf, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


@query("op2_repeated_passages")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = RepeatedPassages()(table(spark, sf, "documents"))
    n_kept = F.octet_length("kept").cast("bigint")
    return cleaned.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - n_kept).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 1)) AS s FROM d),
w AS (SELECT doc_id, s, array_to_string(list_slice(lines, s + 1, s + 2), chr(10)) AS k FROM s),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM w),
g AS (SELECT DISTINCT doc_id, unnest([s, s + 1]) AS i FROM f WHERE rn > 1),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(lines) AS n_lines,
             list_filter(lines, lambda x, i: NOT coalesce(list_contains(gone, i - 1), false)) AS kept
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_lines, n_lines - len(kept) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = RepeatedLines()(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_removed"),
        F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"),
    )


@query("op1_html_extraction")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = WrapperExtraction()(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op5_chat_formatting")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    chat = ChatFormat()
    return chat.read_back(chat.segments(turns.unionByName(probe)))


@query("op7_token_counts")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens before and after a cleaning pass over every document."""
    docs = table(spark, sf, "documents")
    edited = docs.select("doc_id", "text", cleaning_column()("text").alias("edits"))
    return EditAwareCounts(tokenizer_path("byte_bpe_50k.json")).recount(edited, "edits", texts=False)


# CRC-32 with the reflected polynomial EDB88320, byte by byte; near words share a text with one character left out.
VARIANTS_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc, r, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents)
  WHERE length(r) >= 7 GROUP BY doc, r
), bytes AS (
  SELECT r, n, flatten(list_transform(string_split(doc || ':' || r, ''),
                       lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs
), marked AS (
  SELECT r, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS w, n FROM marked)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2
), gaps AS (
  SELECT w, n, i, left(w, i::INT) || substr(w, i::INT + 2) AS s FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM words)
), near AS (
  SELECT a.w, b.w AS v, b.n FROM gaps a JOIN gaps b ON a.s = b.s AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM gaps a JOIN words b ON a.s = b.w
  UNION SELECT b.w, a.w, a.n FROM gaps a JOIN words b ON a.s = b.w
), best AS (
  SELECT w, count(*) AS k, first(v ORDER BY n DESC, v) AS v, max(n) AS m FROM near GROUP BY w
), formed AS (
  SELECT words.w, words.n, coalesce(k, 0) AS k, CASE WHEN m >= 10 * words.n THEN v END AS v, CASE WHEN m >= 10 * words.n THEN m END AS m
  FROM words LEFT JOIN best USING (w)
), chain AS (
  SELECT w, w AS root, v AS onward FROM formed
  UNION ALL SELECT c.w, f.w, f.v FROM chain c JOIN formed f ON c.onward = f.w
)
SELECT f.w AS word, f.v AS form, c.root, f.n, f.k AS n_near, f.m AS form_n FROM formed f JOIN chain c ON f.w = c.w AND c.onward IS NULL
"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return SpellingVariants()(CorpusWords()(table(spark, sf, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


def clusters_sql(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """Every round spelt out: all distances, the nearest centroid, the floor of the mean."""
    assign = """SELECT vec_id, v, min(struct_pack(d := d, j := j)) AS m FROM (
    SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY r, vec_id, v"""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        if r < rounds:
            sums = f"""SELECT j, list(s ORDER BY i) AS c FROM (
    SELECT j, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS s FROM (SELECT m.j AS j, unnest(range({dims})) AS i, unnest(v) AS x FROM a{r}) GROUP BY j, i) GROUP BY j"""
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN ({sums}) n ON n.j = c{r}.j)")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON m.j = c{rounds}.j"""


@query("op12_centroid_clusters", clusters_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return CentroidClusters()(table(spark, sf, "embeddings"))


@query("op13_embedding_near_duplicates")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return EmbeddingNearDuplicates()(table(spark, sf, "embeddings"))

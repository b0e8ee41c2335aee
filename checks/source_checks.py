"""Sources, ingest bookkeeping and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import bigs, check, documents, table
from qaspark.operators.language import INSTRUCTIONS, language_column
from qaspark.session import new_table_path
from qaspark.sources import ingest, taxonomy as tax
from qaspark.sources.jsonl import read_jsonl, without_context, write_jsonl
from qaspark.sources.markdown import scan_manifest, upload_ok


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@check(
    "markdown_scan",
    "S1",
    "SELECT 'doc-' || d.doc_id AS source_md, d.text FROM documents d LEFT JOIN labels l USING (doc_id) "
    "WHERE coalesce(CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'ok' END, 'ok') = 'ok'",
)
def markdown_scan(spark, sf):
    path = F.concat(F.lit("doc-"), "doc_id")
    manifest = _labelled(spark, sf).select(
        F.when(F.col("lang") != "en", path).otherwise(F.lit("pages/x.pdf")).alias("source_path"),
        F.when(F.col("lang") == "en", path).otherwise(F.lit("")).alias("output_md_path"),
        F.when(F.col("toxic") == 1, F.lit("failed")).when(F.col("quality") == 1, F.lit("ok")).alias("status"),
    )
    return scan_manifest(manifest, documents(spark, sf))


@check("jsonl_roundtrip", "S2 S3", "SELECT doc_id, text, lang FROM documents")
def jsonl_roundtrip(spark, sf):
    path = new_table_path(spark, "jsonl")
    write_jsonl(table(spark, sf, "documents"), path, omit=("source", "n_chars"))
    return read_jsonl(spark, path, "doc_id bigint, text string, lang string")


@check("omit_context", "S4", "SELECT doc_id, lang FROM documents")
def omit_context(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("chunk_text"), F.col("text").alias("context"))
    return without_context(rows)


_PATH_SQL = (
    "'in/' || source || '/doc.' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.docx' WHEN 'de' THEN '.Jpeg' ELSE '.txt' END"
)


def _paths(spark, sf):
    ext = (
        F.when(F.col("lang") == "en", F.lit(".PDF")).when(F.col("lang") == "fr", F.lit(".docx"))
        .when(F.col("lang") == "de", F.lit(".Jpeg")).otherwise(F.lit(".txt"))
    )
    path = F.concat(F.lit("in/"), "source", F.lit("/doc."), "doc_id", ext)
    return _labelled(spark, sf).withColumn("source_path", path)


@check(
    "ingest_classify",
    "S5",
    f"SELECT {_PATH_SQL} AS source_path, CASE lang WHEN 'fr' THEN 'skipped' WHEN 'es' THEN NULL ELSE 'convert' END AS kind FROM documents",
)
def ingest_classify(spark, sf):
    return _paths(spark, sf).select("source_path", ingest.classify(F.col("source_path")).alias("kind"))


_RESULT_SQL = (
    f"r AS (SELECT {_PATH_SQL} AS source_path, sha256(text) AS digest, lang, text, n_chars, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS rc, "
    "coalesce(quality, 1) = 1 AS has_output, CASE WHEN source = 'src1' THEN text END AS copy_error FROM documents LEFT JOIN labels USING (doc_id)), "
    "o AS (SELECT *, CASE WHEN lang = 'fr' THEN 'skipped' WHEN rc = 0 AND has_output AND copy_error IS NULL THEN 'ok' ELSE 'failed' END AS status FROM r WHERE lang <> 'es')"
)


@check(
    "ingest_outcomes",
    "S5 S9",
    f"WITH {_RESULT_SQL} SELECT source_path, status, CASE WHEN status = 'ok' THEN 'out/' || regexp_replace(source_path, '[.][^./]+$', '.md') ELSE '' END AS output_md_path, "
    "CASE WHEN status = 'skipped' THEN 'E_UNSUPPORTED_EXT' WHEN status = 'ok' THEN NULL WHEN rc = 0 AND NOT has_output THEN 'E_MINERU_OUTPUT_MISSING' ELSE 'E_MINERU_FAILED' END AS error_code, "
    "CASE WHEN status <> 'skipped' THEN digest END AS sha256, CASE WHEN status <> 'skipped' AND copy_error IS NULL THEN n_chars END AS duration_ms, "
    "CASE WHEN status = 'failed' AND copy_error IS NULL THEN right(text, 4000) END AS stderr_tail, left(copy_error, 2000) AS error_detail FROM o",
)
def ingest_outcomes(spark, sf):
    rows = _paths(spark, sf)
    files = rows.select("source_path", ingest.classify(F.col("source_path")).alias("kind"), F.sha2("text", 256).alias("sha256"))
    results = rows.select(
        "source_path",
        F.when(F.col("toxic") == 1, F.lit(2)).otherwise(F.lit(0)).alias("returncode"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("has_output"),
        F.when(F.col("source") == "src1", F.col("text")).alias("copy_error"),
        F.col("text").alias("stderr"),
        F.col("n_chars").alias("duration_ms"),
        F.lit("1.0").alias("version"),
        F.lit("auto").alias("backend"),
    )
    manifest = ingest.file_manifest(files.filter(F.col("kind").isNotNull()), results, "out/")
    return manifest.select(
        "source_path", "status", "output_md_path", "error_code", "sha256", "duration_ms", "stderr_tail", "error_detail"
    )


@check(
    "url_layout",
    "S6 S7",
    "WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM "
    "(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS url FROM pages)) "
    "SELECT page_id, host AS url_host, left(sha256(url), 16) AS url_fingerprint, "
    "CASE WHEN host <> '' THEN 'urls/' || replace(lower(host), ':', '_') || '/' || left(sha256(url), 16) END AS rel_path FROM u",
)
def url_layout(spark, sf):
    relative = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    pages = table(spark, sf, "pages").select("page_id", relative.alias("url"))
    return ingest.url_layout(pages).select("page_id", "url_host", "url_fingerprint", "rel_path")


_FETCHED_SQL = (
    "f AS (SELECT page_id, url, html, CASE WHEN url LIKE 'https%' THEN ' Text/HTML; charset=utf-8' WHEN url LIKE '%m.%' THEN 'application/pdf' END AS head, "
    "CASE WHEN url LIKE '%ref=%' THEN 'APPLICATION/PDF;v=1' ELSE 'text/plain' END AS gt, contains(url, '#') AS sniff, contains(url, '/de/') AS lost FROM pages), "
    "e AS (SELECT *, CASE WHEN head LIKE ' Text%' THEN 'E_URL_HTML_NOT_SUPPORTED' WHEN lost THEN 'E_MINERU_FAILED' "
    "WHEN gt LIKE 'APP%' OR head IS NOT NULL OR sniff THEN NULL ELSE 'E_URL_NOT_PDF' END AS refused FROM f)"
)


def _fetched(spark, sf):
    url = F.col("url")
    body = F.when(F.contains(url, F.lit("#")), F.concat(F.lit("%PDF-1.4 "), "html")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.when(url.startswith("https"), F.lit(" Text/HTML; charset=utf-8"))
        .when(F.contains(url, F.lit("m.")), F.lit("application/pdf")).alias("head_type"),
        F.when(F.contains(url, F.lit("ref=")), F.lit("APPLICATION/PDF;v=1")).otherwise(F.lit("text/plain")).alias("get_type"),
        F.when(~F.contains(url, F.lit("/de/")), F.encode(body, "utf-8")).alias("body"),
        F.sha2("html", 256).alias("file"),
    )


@check("url_acceptance", "S8", f"WITH {_FETCHED_SQL} SELECT page_id, refused AS error_code FROM e")
def url_acceptance(spark, sf):
    error = ingest.url_error(F.col("head_type"), F.col("get_type"), F.col("body"))
    return _fetched(spark, sf).select("page_id", error.alias("error_code"))


@check(
    "url_manifest",
    "S8 S9",
    f"WITH {_FETCHED_SQL}, h AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, left(sha256(url), 16) AS fp, length(html) % 3 AS rc FROM e) "
    "SELECT url AS source_path, CASE WHEN refused IS NULL AND rc = 0 THEN 'ok' ELSE 'failed' END AS status, "
    "CASE WHEN refused IS NULL AND rc = 0 THEN 'out/urls/' || replace(lower(host), ':', '_') || '/' || fp || '/source.md' ELSE '' END AS output_md_path, "
    "CASE WHEN refused IS NOT NULL THEN refused WHEN rc > 0 THEN 'E_MINERU_FAILED' END AS error_code, "
    "CASE WHEN refused IS NULL THEN sha256(CASE WHEN sniff THEN '%PDF-1.4 ' || html ELSE html END) END AS sha256, host AS url_host, fp AS url_fingerprint FROM h",
)
def url_manifest(spark, sf):
    fetched = _fetched(spark, sf)
    results = table(spark, sf, "pages").select(
        "url", F.sha2("html", 256).alias("file"), (F.length("html") % 3).alias("returncode"), F.lit(True).alias("has_output"),
        F.lit(None).cast("string").alias("copy_error"), F.lit("log").alias("stderr"), F.length("html").alias("duration_ms"),
        F.lit("1.0").alias("version"), F.lit("auto").alias("backend"),
    )
    done = ingest.url_manifest(fetched, results, "out", ("url", "file"))
    return done.select("source_path", "status", "output_md_path", "error_code", "sha256", "url_host", "url_fingerprint")


@check("manifest_echo", "S10", "SELECT page_id, url AS source_path, 'noop' AS stage FROM pages")
def manifest_echo(spark, sf):
    return ingest.echo_manifest(table(spark, sf, "pages").select("page_id", F.col("url").alias("source_path")))


@check(
    "upload_acceptance",
    "S14",
    "SELECT doc_id, lang IN ('en', 'de') AND octet_length(encode(text)) BETWEEN 1 AND 4000 AS accepted FROM documents",
)
def upload_acceptance(spark, sf):
    name = F.concat(
        "source", F.when(F.col("lang") == "en", F.lit(".MD")).when(F.col("lang") == "de", F.lit(".md")).otherwise(F.lit(".txt"))
    )
    return table(spark, sf, "documents").select("doc_id", upload_ok(name, F.encode("text", "utf-8"), 4000).alias("accepted"))


# --- taxonomy tables: language as first level, source as second, in order of first appearance -----------

_CATS_SQL = (
    "cats AS (SELECT lang AS level1_name, source AS level2_name, min(doc_id) AS cat_ord, 'texts in ' || lang AS focus, 'from ' || source AS prompt_hint "
    "FROM documents GROUP BY lang, source)"
)


def categories(spark, sf):
    grouped = table(spark, sf, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("cat_ord"))
    return grouped.select(
        F.col("lang").alias("level1_name"), F.col("source").alias("level2_name"), "cat_ord",
        F.concat(F.lit("texts in "), "lang").alias("focus"), F.concat(F.lit("from "), "source").alias("prompt_hint"),
    )


@check(
    "taxonomy_catalog",
    "Q14 S12",
    f"WITH {_CATS_SQL} SELECT cat_ord, level1_name || ' > ' || level2_name || ' | ' || focus || ' | ' || prompt_hint AS line FROM cats",
)
def taxonomy_catalog(spark, sf):
    return tax.catalog_lines(categories(spark, sf))


@check(
    "taxonomy_tree",
    "A6",
    f"WITH {_CATS_SQL}, firsts AS (SELECT level1_name, min(cat_ord) AS ord1 FROM cats GROUP BY 1) "
    "SELECT -1 AS ord1, -1 AS ord2, '01' AS level, 'root/Texts' AS label, 0::BIGINT AS indent UNION ALL SELECT ord1, -1, '02', level1_name, 1 FROM firsts "
    "UNION ALL SELECT ord1, cat_ord, '03', level2_name, 2 FROM cats JOIN firsts USING (level1_name)",
)
def taxonomy_tree(spark, sf):
    return bigs(tax.taxonomy_tree(categories(spark, sf), "Texts"))


@check(
    "taxonomy_counts",
    "A5",
    f"WITH {_CATS_SQL} SELECT count(DISTINCT level1_name) AS level1_count, count(*) AS category_count FROM cats",
)
def taxonomy_counts(spark, sf):
    return tax.taxonomy_counts(categories(spark, sf))


@check(
    "category_lookup",
    "J2 J3",
    "SELECT d.doc_id, d.lang AS level1_name, d.source AS level2_name, 'texts in ' || d.lang AS focus FROM documents d LEFT JOIN labels l USING (doc_id) "
    "WHERE d.lang <> 'fr' AND coalesce(l.quality, 1) = 1",
)
def category_lookup(spark, sf):
    from qaspark.operators.taxonomy import attach_categories, known_enums

    tags = _labelled(spark, sf).select(
        "doc_id", F.col("lang").alias("level1_name"), F.col("source").alias("level2_name"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, F.lit("fact")).otherwise(F.lit("poor")).alias("task_type"),
        F.lit("direct").alias("reasoning_style"),
    )
    known = known_enums(tags, ["fact"], ["direct"])
    listed = categories(spark, sf).filter("level1_name <> 'fr'")
    return attach_categories(known, listed).select("doc_id", "level1_name", "level2_name", "focus")


@check(
    "language_instruction",
    "F15",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'auto' WHEN 'de' THEN 'zh' END AS language, "
    f"CASE lang WHEN 'en' THEN '{INSTRUCTIONS['en']}' WHEN 'fr' THEN '{INSTRUCTIONS['auto']}' WHEN 'de' THEN '{INSTRUCTIONS['zh']}' END AS instruction FROM documents",
)
def language_instruction(spark, sf):
    wanted = (
        F.when(F.col("lang") == "en", F.lit(" EN ")).when(F.col("lang") == "fr", F.lit("Auto"))
        .when(F.col("lang") == "de", F.lit("zh\n")).otherwise(F.col("lang"))
    )
    language, instruction = language_column(wanted)
    return table(spark, sf, "documents").select("doc_id", language.alias("language"), instruction.alias("instruction"))

"""Ingest bookkeeping: which files and URLs are taken, where they go and what became of them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qaspark.functions.text import WS
from qaspark.schemas import MANIFEST

# File classes and error codes of the ingest manifest.
OFFICE_EXTENSIONS = ("docx", "doc", "ppt", "pptx")
CONVERTED_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp", "gif")
PARSER = "mineru_local"
E_CONVERTER_MISSING = "E_MINERU_NOT_FOUND"
E_FAILED = "E_MINERU_FAILED"
E_OUTPUT_MISSING = "E_MINERU_OUTPUT_MISSING"
E_URL_HTML = "E_URL_HTML_NOT_SUPPORTED"
E_URL_NOT_PDF = "E_URL_NOT_PDF"
E_UNSUPPORTED = "E_UNSUPPORTED_EXT"
FINGERPRINT_HEX = 16
STDERR_TAIL = 4000
ERROR_DETAIL = 2000
# What a converter result tells, in the order in which results with equal keys are chosen.
RESULT = ("returncode", "has_output", "copy_error", "stderr", "duration_ms", "version", "backend")


def suffix(path: Column) -> Column:
    """Lower-cased file suffix without the dot; a leading or trailing dot makes no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^/.]+)\z", 1))


def classify(path: Column) -> Column:
    """``skipped`` for office files, ``convert`` for documents and images, null for anything else."""
    return F.when(suffix(path).isin(*OFFICE_EXTENSIONS), F.lit("skipped")).when(
        suffix(path).isin(*CONVERTED_EXTENSIONS), F.lit("convert")
    )


def _fill(df: DataFrame) -> DataFrame:
    """All manifest columns in order, absent ones null."""
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in MANIFEST.items()
        ]
    )


def any_case(extensions: tuple[str, ...]) -> str:
    """A path filter for files with one of the extensions in any case; other files are not opened."""
    letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(letters(e) for e in extensions) + "}"


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` that get a manifest row: ``(source_path, kind, sha256, length)``.

    Paths are relative to ``path``. Only files that will be converted are read; of skipped ones the listing is enough,
    so their size does not matter.
    """
    root = _absolute(spark, path)

    def files(extensions: tuple[str, ...]) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(extensions))
        relative = F.substring(plain_path(F.col("path")), len(root) + 2, 1 << 30)
        return reader.load(path).withColumn("source_path", relative).withColumn("kind", classify(F.col("source_path"))).filter(F.col("kind").isNotNull())

    converted = files(CONVERTED_EXTENSIONS).select("source_path", "kind", F.sha2("content", 256).alias("sha256"), "length")
    skipped = files(OFFICE_EXTENSIONS).select("source_path", "kind", F.lit(None).cast("string").alias("sha256"), "length")
    return converted.unionByName(skipped)


def plain_path(path: Column) -> Column:
    """One spelling of a file path: decoded, without scheme and host."""
    bare = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)", "")
    # a plus sign is itself in a path, unlike in a form
    decoded = F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(path, F.lit(":/")), decoded).otherwise(path)


def _absolute(spark: SparkSession, path: str) -> str:
    """The folder as ``plain_path`` spells its files, asked from the listing itself."""
    from urllib.parse import unquote, urlparse

    parts = urlparse(path)
    if parts.scheme:
        return unquote(parts.path).rstrip("/")
    return path.rstrip("/") if path.startswith("/") else os.path.abspath(path)


def missing_converter(output_dir: str, spark: SparkSession) -> DataFrame:
    """The manifest of a run that found no converter: one failed row for the whole run."""
    row = [("", "", "failed", PARSER, E_CONVERTER_MISSING, "file")]
    names = "source_path string, output_md_path string, status string, parser string, error_code string, source_kind string"
    return _fill(spark.createDataFrame(row, names).withColumn("source_path", F.lit(output_dir)))


def outcome(returncode: Column, has_output: Column, copy_error: Column) -> tuple[Column, Column]:
    """Status and error code of one converter run."""
    ok = (returncode == 0) & has_output
    status = F.when(ok & copy_error.isNull(), F.lit("ok")).otherwise(F.lit("failed"))
    code = (
        F.when(~ok & (returncode == 0), F.lit(E_OUTPUT_MISSING))
        .when(~ok | copy_error.isNotNull(), F.lit(E_FAILED))
    )
    return status, code


def file_manifest(files: DataFrame, results: DataFrame, output_dir: str) -> DataFrame:
    """Manifest of a directory ingest.

    ``files``: ``(source_path, kind, sha256)``; ``results``: one converter result per converted file,
    ``(source_path, returncode, has_output, copy_error, stderr, duration_ms, version, backend)``.
    """
    joined = files.join(results, "source_path", "left")
    status, code = outcome(F.col("returncode"), F.col("has_output"), F.col("copy_error"))
    skipped = F.col("kind") == "skipped"
    copied = F.col("copy_error").isNull()
    stem = F.regexp_replace("source_path", r"\.[^./]+\z", ".md")
    return _fill(
        joined.select(
            "source_path",
            F.when(~skipped & (status == "ok"), F.concat(F.lit(output_dir.rstrip("/") + "/"), stem))
            .otherwise(F.lit(""))
            .alias("output_md_path"),
            F.when(skipped, F.lit("skipped")).otherwise(status).alias("status"),
            F.lit(PARSER).alias("parser"),
            F.when(skipped, F.lit(E_UNSUPPORTED)).otherwise(code).alias("error_code"),
            F.when(~skipped, F.col("sha256")).alias("sha256"),
            F.when(~skipped & copied, F.col("version")).alias("mineru_version"),
            F.when(~skipped & copied, F.col("backend")).alias("mineru_backend"),
            F.lit("file").alias("source_kind"),
            F.when(~skipped & copied, F.col("duration_ms")).alias("duration_ms"),
            F.when(~skipped & copied & (status == "failed"), F.right("stderr", F.lit(STDERR_TAIL))).alias("stderr_tail"),
            F.left("copy_error", F.lit(ERROR_DETAIL)).alias("error_detail"),
        )
    )


def netloc(url: Column) -> Column:
    """Network location as written (case, user and port kept); empty unless ``scheme://`` leads."""
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host_segment(loc: Column) -> Column:
    """One path segment for a network location: lower case, ``:`` becomes ``_``, brackets stay.

    ``host:port`` and ``[addr]:port`` both end in ``_port`` by the same rule.
    """
    return F.translate(F.lower(loc), ":", "_")


def url_layout(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``url_host``, ``url_fingerprint`` and ``rel_path``; a URL without a host keeps its row and has no path."""
    host = F.coalesce(netloc(F.col(url)), F.lit(""))
    folder = F.concat_ws("/", F.lit("urls"), host_segment(F.col("url_host")), "url_fingerprint")
    return (
        df.withColumn("url_host", host)
        .withColumn("url_fingerprint", F.left(F.sha2(F.col(url), 256), F.lit(FINGERPRINT_HEX)))
        .withColumn("rel_path", F.when(F.col("url_host") != "", folder))
    )


def content_type(header: Column) -> Column:
    """Media type without parameters, lower case; empty counts as absent."""
    bare = F.regexp_replace(F.substring_index(header, ";", 1), rf"\A[{WS}]+|[{WS}]+\z", "")
    return F.nullif(F.lower(bare), F.lit(""))


def _says_pdf(kind: Column) -> Column:
    return F.coalesce(F.contains(kind, F.lit("application/pdf")), F.lit(False))


def url_error(head_type: Column, get_type: Column, body: Column) -> Column:
    """Error code of a fetched URL, null when it is accepted as a PDF; a null body is a failed fetch."""
    head, get = content_type(head_type), content_type(get_type)
    says_html = F.coalesce(F.contains(head, F.lit("text/html")), F.lit(False))
    sniffed = F.substring(body, 1, 4) == F.lit(b"%PDF")
    return (
        F.when(says_html & ~_says_pdf(head), F.lit(E_URL_HTML))
        .when(body.isNull(), F.lit(E_FAILED))
        .when(~_says_pdf(get) & ~_says_pdf(head) & ~sniffed, F.lit(E_URL_NOT_PDF))
    )


def url_manifest(fetched: DataFrame, results: DataFrame, output_dir: str, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Manifest of fetched URLs ``(url, head_type, get_type, body)`` and converter ``results``: one row for each fetch.

    ``keys`` are the columns of both tables that name a result. A URL that was fetched more than once needs one beside ``url``
    that tells its files apart. Of several results with equal keys the smallest counts, return code first.
    """
    results = results.groupBy(*keys).agg(F.min(F.struct(*RESULT)).alias("_result")).select(*keys, "_result.*")
    refused = url_error(F.col("head_type"), F.col("get_type"), F.col("body"))
    # a URL without a host cannot have been fetched; its row stays, as failed
    checked = url_layout(fetched).withColumn("_refused", F.when(F.col("url_host") == "", F.lit(E_FAILED)).otherwise(refused))
    joined = checked.join(results, list(keys), "left")
    status, code = outcome(F.col("returncode"), F.col("has_output"), F.col("copy_error"))
    taken = F.col("_refused").isNull()
    copied = F.col("copy_error").isNull()
    root = output_dir.rstrip("/") + "/"
    return _fill(
        joined.select(
            F.col("url").alias("source_path"),
            F.when(taken & (status == "ok"), F.concat(F.lit(root), "rel_path", F.lit("/source.md")))
            .otherwise(F.lit(""))
            .alias("output_md_path"),
            F.when(taken, status).otherwise(F.lit("failed")).alias("status"),
            F.lit(PARSER).alias("parser"),
            F.when(taken, code).otherwise(F.col("_refused")).alias("error_code"),
            F.when(taken, F.sha2("body", 256)).alias("sha256"),
            F.when(taken & copied, F.col("version")).alias("mineru_version"),
            F.when(taken & copied, F.col("backend")).alias("mineru_backend"),
            F.lit("url").alias("source_kind"),
            "url_host",
            "url_fingerprint",
            F.when(taken & copied, F.col("duration_ms")).alias("duration_ms"),
            F.when(taken & copied & (status == "failed"), F.right("stderr", F.lit(STDERR_TAIL))).alias("stderr_tail"),
            F.when(taken, F.left("copy_error", F.lit(ERROR_DETAIL))).alias("error_detail"),
        )
    )


def echo_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("stage", F.lit("noop"))

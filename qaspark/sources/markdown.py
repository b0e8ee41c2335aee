"""Markdown documents and uploads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qaspark.functions.text import first_filled
from qaspark.sources.ingest import any_case, plain_path

DEFAULT_UPLOAD_LIMIT = 32 * 1024 * 1024


def read_markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file, whole text: ``(source_md, text)``."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_md"), F.col("value").alias("text")
    )


def usable_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest rows whose status is ok (or absent), with the path their Markdown is read from."""
    return manifest.filter(F.coalesce("status", F.lit("ok")) == "ok").withColumn(
        "source_md", first_filled(F.col("output_md_path"), F.col("source_path"))
    )


def scan_manifest(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts named by usable manifest rows; a path without a text is passed over silently.

    Both sides are keyed by the decoded path, whether or not they spell a scheme, and neither is assumed small, so this
    is a shuffled equi join. A path listed many times stays a repeated row, as in the input.
    """
    named = usable_manifest(manifest).select("source_md", plain_path(F.col("source_md")).alias("_path"))
    found = texts.select(plain_path(F.col("source_md")).alias("_path"), "text")
    return named.join(found, "_path").select("source_md", "text")


def accepted_uploads(files: DataFrame, limit: int = DEFAULT_UPLOAD_LIMIT) -> DataFrame:
    """Rows of ``(path, content)`` that are non-empty valid UTF-8 ``.md`` files within the size limit."""
    return files.filter(upload_ok(F.col("path"), F.col("content"), limit))


def upload_ok(name: Column, content: Column, limit: int = DEFAULT_UPLOAD_LIMIT) -> Column:
    size = F.octet_length(content)
    # the name and size tests come first so that only candidates are decoded
    return F.lower(name).endswith(".md") & (size > 0) & (size <= limit) & F.is_valid_utf8(content.cast("string"))


def read_uploads(spark: SparkSession, path: str, limit: int = DEFAULT_UPLOAD_LIMIT) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(("md",)))
    # the bound on the length is pushed to the listing, so larger files are not opened
    files = reader.load(path).filter((F.col("length") > 0) & (F.col("length") <= limit))
    return accepted_uploads(files, limit).select(
        "path", F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("text")
    )

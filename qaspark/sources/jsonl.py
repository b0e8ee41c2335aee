"""JSON Lines as the exchange format between stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaspark.functions.jsontext import is_object, strict_json
from qaspark.functions.text import is_blank

# Long text fields left out of scored, expanded and reasoning outputs.
CONTEXT_FIELDS = ("chunk_text", "context")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSONL table with a declared schema (DDL text).

    Blank lines and lines holding another JSON value are skipped; a malformed line fails the read.
    """
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    parsed = strict_json(F.col("value"))
    keep = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("malformed JSON line: "), "value")).cast("boolean"))
    objects = lines.filter(keep.otherwise(is_object(parsed)))
    return objects.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def without_context(df: DataFrame, fields: Iterable[str] = CONTEXT_FIELDS) -> DataFrame:
    return df.drop(*fields)


def write_jsonl(df: DataFrame, path: str, omit: Iterable[str] = (), mode: str = "errorifexists") -> None:
    """One object per line, UTF-8; null columns are left out of the objects."""
    df.drop(*omit).write.mode(mode).option("ignoreNullFields", "true").json(path)

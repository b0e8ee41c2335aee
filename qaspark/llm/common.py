"""Row identity, whole-row selection and blocks of a bounded side, shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

ROW = ("_r1", "_r2")
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
BLOCK_BYTES = 32 * 1024 * 1024


def ship(df: DataFrame) -> None:
    """Let Python workers import this package, once for each Spark context.

    Functions then travel by name, and what a worker has learnt (a cache) serves its later tasks too.
    """
    # batches of long texts, their copies in both processes included, stay small unless the session says otherwise
    settings = df.sparkSession.conf
    if settings.get(BATCH, None) in (None, "67108864b"):
        settings.set(BATCH, BATCH_BYTES)
    context = df.sparkSession.sparkContext
    if getattr(context, "_qaspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-ship-")), "qaspark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "qaspark").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(archive)
    context._qaspark_shipped = True


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_id() -> tuple[Column, Column]:
    """Two longs that name a row of ``documents``: the id and a hash of the text.

    Rows that agree in both are the same document twice; every operator gives them the same answer.
    Null ids are told apart from any number by the hash.
    """
    return F.coalesce("doc_id", F.lit(0)).alias("_r1"), F.xxhash64(F.isnull("doc_id"), text_of()).alias("_r2")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (never null) and the row name; all other columns are left behind, so none can clash."""
    return docs.select("doc_id", text_of().alias("text"), *row_id())


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) whose name is in ``kept`` (``_r1``, ``_r2``), one for each name.

    The join and the numbering use the same keys, so the texts are shuffled once. Among rows that are equal in
    id and text the one that is first by its other columns stays.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    named = docs.withColumns(dict(zip(ROW, row_id())))
    order = [F.xxhash64(*rest)] if rest else [F.col("_r1")]
    once = Window.partitionBy(*ROW).orderBy(*order)
    return (
        named.join(kept.select(*ROW).distinct(), list(ROW), "left_semi")
        .withColumn("_copy", F.row_number().over(once))
        .filter("_copy = 1")
        .select(*columns)
    )


def blocks(side: DataFrame, id_column: str, text_column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list]:
    """A small side as lists of (id, text) of about ``limit`` bytes each.

    The side is measured first; however large it is, no list handed to the executors outgrows the limit by more
    than the unevenness of a hash, and each list costs one pass over the documents.
    """
    narrow = side.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(size // limit) + 1
    for b in range(n):
        yield [tuple(r) for r in narrow.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()]

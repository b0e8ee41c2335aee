"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; a cluster's own values win where it sets them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("qaspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only when the session names none (tests, a laptop) is a local one made, and it is then
    recorded in the session so that later calls reuse it.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("qaspark.scratch.dir", None)
    )
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-qaspark-")
    spark.conf.set("qaspark.scratch.dir", folder)
    return folder


# The tables that the innermost open ``scratch`` block has written.
_written: ContextVar[list[str] | None] = ContextVar("written tables", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Paths of the tables that ``cut`` writes inside the block, for ``drop_tables`` once nothing reads them."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, wherever the shared folder is; paths that are gone already do no harm."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def distil(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """``cut`` what ``build`` returns, then drop the tables that it wrote on the way."""
    with scratch() as used:
        df = build()
    out = cut(df, label)
    drop_tables(spark, used)
    return out


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# How tables of texts are written that stay until the session's end: a tenth smaller than at the default level.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a write inside the block go when it is done, not when the driver happens to collect its garbage."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def cut_in_buckets(df: DataFrame, label: str, by: str, order: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` bucketed by ``by`` as a table of the session's catalog, which joins on ``by`` with another one read in place.

    The rows are dealt out in one shuffle and sorted by ``order``. Without it they stay in the tasks and in the order that they have:
    then each task should have long runs of few values, for each of which it writes a file.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    name, path = f"qaspark_{label.replace('-', '_')}_{uuid.uuid4().hex}", new_table_path(spark, label)
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    dealt = df.repartition(buckets, by).write.sortBy(*order) if order else df.write
    # files of the values of a task are open together up to this number; only beyond it a task sorts its rows
    with shuffles_dropped(spark), setting(spark, OPEN_FILES, "0" if order else "64"):
        dealt.bucketBy(buckets, by).option("path", path).options(**PACKED).saveAsTable(name)
    return spark.table(name)


def cut(df: DataFrame, label: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Results of non-deterministic or costly steps (a model call, a partition numbering) are then
    fixed: a lost executor re-reads files instead of repeating the step, and later stages still
    get column pruning and filter pushdown from Parquet.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    df.write.mode("error").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

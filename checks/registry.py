"""Query registry, input tables and SQL fragments shared by the checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qaspark.functions.text import SPACE_CODEPOINTS
from qaspark.sources.tables import spread

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Check] = {}


def check(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:

    def register(run: Run) -> Run:
        assert name not in REGISTRY, name
        REGISTRY[name] = Check(name, tuple(covers.split()), run, sql)
        return run

    return register


# --- Spark inputs -----------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its whole text."""
    scan = table(spark, sf, "documents").select("doc_id", "text")
    return spread(scan).select(F.concat(F.lit("doc-"), "doc_id").alias("source_md"), "text")


def headed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as Markdown: a first heading, lines as paragraphs, a closing section."""
    body = F.concat(
        F.lit("# "), "source", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")),
        F.lit("\n\n###  About "), "lang", F.lit(" \n\n\n"), F.lit("Document "), "doc_id", F.lit(" of "), "source",
        F.lit(" has "), "n_chars", F.lit(" characters. It is written in "), "lang", F.lit("."),
    )
    scan = spread(table(spark, sf, "documents"))
    return scan.select(F.concat(F.lit("doc-"), "doc_id").alias("source_md"), body.alias("text"))


def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant turn after it as a question record."""
    turns = table(spark, sf, "conversations")
    user = spread(turns).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat(F.lit("conv-"), "conv_id").alias("source_md"),
        F.col("turn").cast("int").alias("chunk_index"),
        F.array(F.lit(0)).alias("rec_ord"),
        "question",
        "answer",
        F.concat("question", F.lit("\n"), "answer").alias("chunk_text"),
    )


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    since = f"cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
    return F.expr(f"cast(cast({since} as decimal(20, 6)) * 1000000 as bigint)")


def bigs(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT and doubles rounded, so that both engines show the same values."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind == "double":
            out.append(F.round(name, 6).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --- SQL fragments ----------------------------------------------------------------------------------

SPACES_SQL = "concat(" + ", ".join(f"chr({c})" for c in SPACE_CODEPOINTS) + ")"
WS_SQL = "".join(rf"\x{{{c:X}}}" for c in SPACE_CODEPOINTS)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES_SQL})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS_SQL}]+'), lambda wd: wd <> '')"


DOCS_SQL = "docs AS (SELECT 'doc-' || doc_id AS source_md, text FROM documents)"

HEADED_SQL = (
    "headed AS (SELECT 'doc-' || doc_id AS source_md, '# ' || source || chr(10) || chr(10) || "
    "replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '###  About ' || lang || ' ' || chr(10) || "
    "chr(10) || chr(10) || 'Document ' || doc_id || ' of ' || source || ' has ' || n_chars || "
    "' characters. It is written in ' || lang || '.' AS text FROM documents)"
)

PAIRS_SQL = (
    "qa AS (SELECT 'conv-' || u.conv_id AS source_md, u.turn AS chunk_index, u.text AS question, a.text AS answer, "
    "u.text || chr(10) || a.text AS chunk_text FROM conversations u JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
)


def chunks_sql(size: int = 512, overlap: int = 0) -> str:
    """CTEs ``docs`` and ``chunks`` of the word windows."""
    step = size - overlap
    return (
        f"{DOCS_SQL}, split_docs AS (SELECT source_md, {words('text')} AS w FROM docs), "
        "starts AS (SELECT source_md, w, unnest(generate_series(0, "
        f"cast(ceil(greatest(len(w) - {size}, 0) / {step}.0) AS BIGINT))) AS chunk_index FROM split_docs WHERE len(w) > 0), "
        "chunks AS (SELECT source_md, chunk_index, "
        f"array_to_string(list_slice(w, chunk_index * {step} + 1, chunk_index * {step} + {size}), ' ') AS chunk_text FROM starts)"
    )

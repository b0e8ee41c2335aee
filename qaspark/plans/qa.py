"""Whole flows: documents or question tables in, stage tables and exports out.

Each flow returns its stage tables by name. Everything stays lazy unless a generator calls a model, ``written`` asks for
stage tables or ``output_dir`` for JSON Lines files; then each stage is computed once, written and read back by
the next one.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from qaspark.operators.agentic import DepthQA, WidthQA
from qaspark.operators.atomic import AtomicQA
from qaspark.operators.base import LimitPerChunk, require
from qaspark.operators.chunking import SemanticChunks, WordChunks
from qaspark.operators.contexts import CONTEXT_TEXTS, MultiHopContexts
from qaspark.operators.expand import ExpandQA, ThinkQA
from qaspark.operators.exchange import ROW_KEY
from qaspark.operators.export import AlpacaExport, MultiHopExport
from qaspark.operators.filters import GradeFilter
from qaspark.operators.generation import Generator
from qaspark.operators.multihop import MultiHopQA
from qaspark.operators.review import session_items
from qaspark.operators.score import ScoreQA
from qaspark.operators.singlehop import SingleHopQA
from qaspark.operators.taxonomy import TagChunks, TaxonomyAnswers, TaxonomyQuestions
from qaspark.session import cut
from qaspark.sources.jsonl import CONTEXT_FIELDS, write_jsonl
from qaspark.sources.taxonomy import Taxonomy

# What tells contexts apart; all their other columns are texts.
CONTEXT_KEYS = ("source_md", "chunk_index", "info_pair_index", "rec_ord")
# Generator names of the single-hop flow.
GENERATORS = ("default", "atomic", "taxonomy")


@dataclass
class Stages:
    """Collects stage tables and, when a folder is given or they (all, or those named) are to be ``written``, writes each one as it is added."""

    output_dir: str | None = None
    written: bool | Collection[str] = False

    def __post_init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame, omit: tuple[str, ...] = ()) -> DataFrame:
        if self.output_dir or self.written is True or (self.written and name in self.written):
            # the cut keeps every column for the next stage and stops it from computing this one again
            df = cut(df, name)
        if self.output_dir:
            write_jsonl(df.drop(ROW_KEY), f"{self.output_dir.rstrip('/')}/{name}.jsonl", omit)
        self.tables[name] = df.drop(ROW_KEY)
        return df


def markdown_qa(
    documents: DataFrame,
    generator: Generator,
    *,
    kind: str = "default",
    taxonomy: Taxonomy | None = None,
    chunk_words: int = 512,
    overlap_words: int = 0,
    question_num: int = 1,
    grades: GradeFilter = GradeFilter(),
    language: str = "zh",
    expand: str | None = None,
    think: bool = False,
    atomic_max_per_task: int = 10,
    output_dir: str | None = None,
    written: bool | Collection[str] = False,
) -> dict[str, DataFrame]:
    """Single-hop flow over ``(source_md, text)``: chunk, generate, score, filter, [expand], [think], export.

    The atomic kind verifies its pairs while it makes them and skips scores and filter.
    """
    require(kind in GENERATORS, "generator must be one of: default, atomic, taxonomy")
    complete = taxonomy is not None and taxonomy.is_complete()
    require(kind != "taxonomy" or complete, "generator='taxonomy' requires a complete taxonomy config")
    out = Stages(output_dir, written)
    chunks = out.add("chunks", WordChunks(chunk_words, overlap_words)(documents))
    generator, chunks = generator.over(chunks, dict.fromkeys(CONTEXT_FIELDS, "chunk_text"))
    if kind == "taxonomy":
        tagged = TagChunks(generator, taxonomy, language)(chunks)
        questions = TaxonomyQuestions(generator, taxonomy, language)(tagged)
        # blank answers do not count against the limit, so it comes after the answers
        generated = LimitPerChunk(question_num)(TaxonomyAnswers(generator, taxonomy, language)(questions))
    elif kind == "atomic":
        generated = AtomicQA(generator, atomic_max_per_task, question_num)(chunks)
    else:
        generated = SingleHopQA(generator, question_num, language)(chunks)
    generated = out.add("qa_generated", generated)
    if kind == "atomic":
        scored = kept = out.add("qa_scored", generated, CONTEXT_FIELDS)
    else:
        scored = out.add("qa_scored", ScoreQA(generator, language)(generated), CONTEXT_FIELDS)
        kept = grades(scored)
    out.tables["qa_filtered"] = kept.drop(ROW_KEY)
    if expand:
        kept = out.add("qa_expanded", ExpandQA(generator, expand, language)(kept), CONTEXT_FIELDS)
    if think:
        kept = out.add("qa_with_think", ThinkQA(generator, language)(kept), CONTEXT_FIELDS)
    out.add("qa_export", AlpacaExport()(kept))
    return out.tables


def markdown_multihop_qa(
    documents: DataFrame,
    generator: Generator,
    *,
    chunk_words: int = 800,
    min_context_sentences: int = 3,
    num_q: int = 5,
    language: str = "zh",
    output_dir: str | None = None,
) -> dict[str, DataFrame]:
    """Multi-hop flow: semantic chunks of up to four characters per word, contexts, pairs, export."""
    out = Stages(output_dir)
    chunks = out.add("chunks", SemanticChunks(max_chunk_chars=chunk_words * 4)(documents))
    builder = MultiHopContexts(language, min_context_sentences=min_context_sentences)
    # a chunk has many contexts: its text is stored once, and they are built again for the rows that are kept
    texts = {name: name for name in chunks.columns if name not in CONTEXT_KEYS}
    generator, chunks = generator.over(chunks, texts, CONTEXT_TEXTS, builder.again)
    contexts = out.add("multihop_contexts", builder(chunks))
    generated = out.add("qa_multihop_generated", MultiHopQA(generator, language, num_q=num_q)(contexts))
    out.add("qa_multihop_export", MultiHopExport()(generated))
    return out.tables


def reattach_context(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """Put the chunk text back on records that were stored without it.

    The chunk table has one row per key; a chunk with many records is the probe side's affair and AQE
    can split it.
    """
    bare = qa.drop(*CONTEXT_FIELDS)
    texts = chunks.select("source_md", "chunk_index", "chunk_text")
    return bare.join(texts, ["source_md", "chunk_index"], "left").withColumn("context", F.col("chunk_text"))


def expand_table(
    qa: DataFrame, generator: Generator, mode: str = "detail", language: str = "zh", chunks: DataFrame | None = None,
    path: str | None = None,
) -> DataFrame:
    """Expand a stored question table, its context joined back when ``chunks`` is given."""
    rows = reattach_context(qa, chunks) if chunks is not None else qa
    done = ExpandQA(generator, mode, language)(rows).drop(*CONTEXT_FIELDS)
    if path:
        write_jsonl(done, path)
    return done


def think_table(
    qa: DataFrame, generator: Generator, language: str = "zh", chunks: DataFrame | None = None, path: str | None = None
) -> DataFrame:
    rows = reattach_context(qa, chunks) if chunks is not None else qa
    done = ThinkQA(generator, language)(rows).drop(*CONTEXT_FIELDS)
    if path:
        write_jsonl(done, path)
    return done


def depth_table(qa: DataFrame, generator: Generator, n_rounds: int = 2, path: str | None = None) -> DataFrame:
    done = DepthQA(generator, n_rounds)(qa)
    if path:
        write_jsonl(done, path)
    return done


def width_table(qa: DataFrame, generator: Generator, path: str | None = None) -> DataFrame:
    done = WidthQA(generator)(qa)
    if path:
        write_jsonl(done, path)
    return done


def review_flow(
    documents: DataFrame, generator: Generator, session_id: str, *, pipeline: str = "singlehop", kind: str = "default",
    min_score: float = 3.0, language: str = "zh", add_depth: bool = False, depth_rounds: int = 2, add_width: bool = False,
    **options,
) -> dict[str, DataFrame]:
    """Stages of a review job: ``session`` (review items) and, where asked for, ``depth`` and ``width``.

    The session is made of all scored rows, or of the generated ones where no scores exist. Depth and width work on the
    generated rows of single-hop jobs, which are written once, before they are scored, so that no stage asks the model again.
    """
    extra = {}
    if pipeline == "multihop":
        rows = markdown_multihop_qa(documents, generator, language=language, **options)["qa_multihop_generated"]
    else:
        if (add_depth or add_width) and options.get("written") is not True:
            options["written"] = (*(options.get("written") or ()), "qa_generated")
        stages = markdown_qa(
            documents, generator, kind=kind, grades=GradeFilter.all_at(min_score), language=language, **options
        )
        rows = stages["qa_generated" if kind == "atomic" else "qa_scored"]
        if add_depth or add_width:
            generated = stages["qa_generated"]
            if add_depth:
                extra["depth"] = depth_table(generated, generator, depth_rounds)
            if add_width:
                extra["width"] = width_table(generated, generator)
    records = rows.withColumn("session_id", F.lit(session_id))
    return {"session": session_items(records, min_score, ("source_md", "chunk_index", "rec_ord")), **extra}


def review_session(documents: DataFrame, generator: Generator, session_id: str, **options) -> DataFrame:
    """The review items of ``review_flow`` alone."""
    return review_flow(documents, generator, session_id, **options)["session"]

"""The one step that asks a model. Three ways to get a response, one contract: a ``response`` column.

* ``ExpressionGenerator``: a Column expression per stage, for tests, dry runs and benchmarks.
* ``TableGenerator``: stored responses joined by prompt hash.
* ``CallableGenerator``: a function given by the user, called inside executors and written once.

A prompt without an answer gets the empty string, which every parser treats as unusable. A null
prompt is not asked and gets the empty string too.

``over`` prepares a generator for rows that carry long texts through many calls: responses are then exchanged as a side
table of keys, hashes and answers, and the texts stay in a ``TextStore``. Equal prompts are asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from qaspark.operators.base import first_per_group
from qaspark.operators.exchange import BLOCK, HASH, PLACE, ROW_KEY, PlacedResponses, TextStore, at_place, block_of, row_key
from qaspark.session import PACKED, cut, cut_in_buckets, drop_tables, scratch, shuffles_dropped


Attach = Callable[[DataFrame], DataFrame]
# What an operator reads of responses: columns added to a table that has ``response``.
Read = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Bare:
    """Answered rows without the texts that lie in a store, and ``attach``, which brings them to rows made of these.

    Where ``again`` is given, what was read of a response need not travel either: rows that keep the columns ``carried`` get it back from ``again``.
    """

    rows: DataFrame
    attach: Attach
    carried: tuple[str, ...] = ()
    again: Attach | None = None


@dataclass(frozen=True)
class Ask:
    """One question per row: which stage, what prompt, and the column its response goes to."""

    stage: str
    prompt: Column
    system: str
    to: str


class Generator(Protocol):
    def ask(self, df: DataFrame, stage: str, prompt: Column, system: str = "") -> DataFrame:
        """``df`` with a ``response`` column."""

    def ask_all(self, df: DataFrame, asks: Sequence[Ask]) -> DataFrame:
        """``df`` with one response column per ask; asks of a row do not depend on each other."""

    def ask_bare(self, df: DataFrame, stage: str, prompt: Column, system: str, read: Read) -> Bare:
        """As ``ask``, with what ``read`` adds, but texts that lie in a store stay there."""

    def over(self, df: DataFrame, texts: Mapping[str, str], *derived) -> tuple[Generator, DataFrame]:
        """A generator that keeps the columns ``texts`` (name to the column it repeats) of ``df`` out of its joins, and the rows to go on with.

        ``derived`` are names of columns that rows made of ``df`` get, and the function that adds them.
        """


@dataclass(frozen=True)
class ExpressionGenerator:
    """Responses computed from the row itself; rules are keyed by stage name."""

    rules: Mapping[str, Column]

    def ask(self, df: DataFrame, stage: str, prompt: Column, system: str = "") -> DataFrame:
        return df.withColumn("response", self._answer(stage, prompt))

    def ask_all(self, df: DataFrame, asks: Sequence[Ask]) -> DataFrame:
        return df.withColumns({a.to: self._answer(a.stage, a.prompt) for a in asks})

    def ask_bare(self, df: DataFrame, stage: str, prompt: Column, system: str, read: Read) -> Bare:
        return Bare(read(self.ask(df, stage, prompt, system)), lambda rows: rows)

    def over(self, df: DataFrame, texts: Mapping[str, str], *derived) -> tuple[Generator, DataFrame]:
        return self, df

    def _answer(self, stage: str, prompt: Column) -> Column:
        return F.coalesce(F.when(prompt.isNotNull(), self.rules[stage]), F.lit(""))


def prompt_hash(prompt: Column, system: str = "") -> Column:
    return F.sha2(F.concat(F.lit(system + "\n"), prompt), 256)


def hash_or_own(prompt: Column, system: str = "") -> Column:
    """The prompt's hash. Rows that ask nothing have no partner; a number of their own instead of one null key spreads them over all tasks."""
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    return F.coalesce(prompt_hash(prompt, system), own)


def store_of(texts: TextStore | None, df: DataFrame) -> TextStore | None:
    """The store, for rows that still carry its key."""
    return texts if texts is not None and ROW_KEY in df.columns else None


@dataclass(frozen=True)
class TableGenerator:
    """Stored responses ``(stage, prompt_hash, response[, resp_ord])``; the lowest ``resp_ord`` wins.

    ``unique`` says that they are a written table with one row for each stage and hash, as ``RecordingGenerator`` gives; it is read in place.

    The responses of a stage are reduced to one row per hash (combined before the shuffle) and written
    once. The join then reads a plain table on that side, which lets AQE split the partition of a prompt
    that a third of all rows ask; it cannot do so above an aggregate.

    Responses with places (``PlacedResponses``) stay where they are: ``ask_bare`` moves hashes and places, reads each response once
    and gives what was read to the rows that come to its place.
    """

    responses: DataFrame
    texts: TextStore | None = None
    unique: bool = False
    _by_stage: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def over(self, df: DataFrame, texts: Mapping[str, str], *derived) -> tuple[Generator, DataFrame]:
        marked = df.withColumn(ROW_KEY, row_key(df))
        store = TextStore.of(marked, texts, *derived)
        return replace(self, texts=store), store.rows(marked)

    def _stored(self, stage: str) -> DataFrame:
        if stage not in self._by_stage:
            rows = self.responses.filter(F.col("stage") == stage)
            if self.unique:
                return rows.select("prompt_hash", F.col("response").alias("_stored"))
            order = F.col("resp_ord") if "resp_ord" in rows.columns else F.col("response")
            unique = rows.groupBy("prompt_hash").agg(F.min_by("response", order).alias("_stored"))
            self._by_stage[stage] = cut(unique, f"stored-{stage}")
        return self._by_stage[stage]

    def ask(self, df: DataFrame, stage: str, prompt: Column, system: str = "") -> DataFrame:
        return self.ask_all(df.drop("response"), [Ask(stage, prompt, system, "response")])

    def ask_all(self, df: DataFrame, asks: Sequence[Ask]) -> DataFrame:
        """All prompts of a row are hashed where the row is; then only hashes and narrow columns move."""
        rows, attach = self._bare(df, asks)
        return attach(rows).select(*df.columns, *[a.to for a in asks])

    def ask_bare(self, df: DataFrame, stage: str, prompt: Column, system: str, read: Read) -> Bare:
        ask = Ask(stage, prompt, system, "response")
        if self.unique and PLACE in self.responses.columns and store_of(self.texts, df):
            return self._placed(df.drop("response"), ask, read)
        rows, attach = self._bare(df.drop("response"), [ask])
        return Bare(read(rows), attach)

    def _placed(self, df: DataFrame, ask: Ask, read: Read) -> Bare:
        """Rows find the places of their responses by the hash of their prompt and go there; rows without a response have null in what is read."""
        held = self.texts.held(df)
        responses = self.responses.filter(F.col("stage") == ask.stage)
        own = F.to_binary(hash_or_own(F.lit(None).cast("string")), F.lit("utf-8"))
        # keys travel in bytes, half as long as their text; of a hash as many bits as a row key has
        told = lambda h: F.substring(F.unhex(h), 1, 16)
        hashed = F.coalesce(told(prompt_hash(ask.prompt, ask.system)), own)
        rows = self.texts.detach(df.withColumns({HASH: hashed, ROW_KEY: F.unhex(ROW_KEY)}))
        index = responses.select(told(F.col("prompt_hash")).alias(HASH), PLACE)
        with scratch() as used, shuffles_dropped(df.sparkSession):
            found = cut(rows.join(index, HASH, "left").drop(HASH), f"found-{ask.stage}", PACKED)
        none = -1 - F.monotonically_increasing_id()
        placed = cut_in_buckets(found.withColumn(BLOCK, F.coalesce(block_of(F.col(PLACE)), none)), f"asked-{ask.stage}", BLOCK, [BLOCK, PLACE])
        drop_tables(df.sparkSession, used)
        written = responses.select("response", PLACE, BLOCK)
        asked = at_place(placed, read(written).drop("response"), "left")

        def again(kept: DataFrame) -> DataFrame:
            rows = cut_in_buckets(kept.withColumn(BLOCK, block_of(F.col(PLACE))), f"kept-{ask.stage}", BLOCK, [BLOCK, PLACE])
            wanted = at_place(written, rows.select(PLACE, BLOCK), "left_semi")
            return at_place(rows, read(wanted).drop("response"), "left").drop(PLACE, BLOCK)

        def attach(rows: DataFrame) -> DataFrame:
            return self.texts.attach(rows.withColumn(ROW_KEY, F.hex(ROW_KEY)), held, if_read=True)

        return Bare(asked, attach, (PLACE,), again)

    def _bare(self, df: DataFrame, asks: Sequence[Ask]) -> tuple[DataFrame, Attach]:
        texts = store_of(self.texts, df)
        held = texts.held(df) if texts else []
        hashed = df.withColumns({f"_h{i}": hash_or_own(a.prompt, a.system) for i, a in enumerate(asks)})
        rows = texts.detach(hashed) if texts else hashed
        for i, a in enumerate(asks):
            stored = self._stored(a.stage).withColumnRenamed("prompt_hash", f"_h{i}")
            rows = rows.join(stored, f"_h{i}", "left").withColumn(a.to, F.coalesce("_stored", F.lit(""))).drop(f"_h{i}", "_stored")
        return rows, lambda found: texts.attach(found, held) if texts else found


ModelCall = Callable[[list[str], str], list[str]]
# Failures of the transport give an empty response; anything else stops the job.
TRANSPORT_ERRORS = (TimeoutError, ConnectionError)


def _model_udf(call: ModelCall, system: str, threads: int):
    """The call as an Arrow UDF. Everything it needs is nested, so workers need not import this package."""
    failures = TRANSPORT_ERRORS

    def answer(prompt: str | None) -> tuple[str, str, str | None]:
        if prompt is None:
            return "", "skipped", None
        try:
            return call([prompt], system)[0], "ok", None
        except failures as exc:
            return "", "failed", str(exc)

    @F.pandas_udf("response string, gen_status string, gen_error string")
    def ask_model(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for prompts in series:
                yield pd.DataFrame(list(pool.map(answer, prompts)), columns=["response", "gen_status", "gen_error"])

    return ask_model.asNondeterministic()


@dataclass(frozen=True)
class CallableGenerator:
    """A user function ``(prompts, system) -> responses`` called once per prompt inside the executors.

    Only the prompt travels to Python. The result is written to the shared folder straight away: the
    call is costly and not repeatable, so no later stage may trigger it again. ``partitions`` sets how
    many tasks call at the same time and ``threads`` how many calls each task keeps open. Over a text store
    the tasks are those of its buckets.
    """

    call: ModelCall
    partitions: int | None = None
    threads: int = 4
    texts: TextStore | None = None

    def over(self, df: DataFrame, texts: Mapping[str, str], *derived) -> tuple[Generator, DataFrame]:
        # the store and the first call both read these rows
        marked = cut(df.withColumn(ROW_KEY, row_key(df)), "marked")
        return replace(self, texts=TextStore.of(marked, texts, *derived)), marked

    def _once(self, df: DataFrame, asks: Sequence[Ask]) -> tuple[DataFrame, Attach]:
        """``df`` without its texts and with a struct ``_a0``, ``_a1``, ... for each ask; of rows with equal prompts one asks.

        The narrow rows are written once with their hashes. The row that asks is chosen among narrow rows and gets its texts from
        the store, so a prompt is built only where it is sent.
        """
        held = self.texts.held(df)
        hashes = {f"_h{i}": hash_or_own(a.prompt, a.system) for i, a in enumerate(asks)}
        rows = written = cut(self.texts.detach(df.withColumns(hashes)), f"asked-{asks[0].stage}")
        for i, a in enumerate(asks):
            asking = first_per_group(written.filter(~F.startswith(f"_h{i}", F.lit("-"))), [f"_h{i}"], [ROW_KEY], 1)
            answer = _model_udf(self.call, a.system, self.threads)(a.prompt).alias(f"_a{i}")
            answers = cut(self.texts.attach(asking, held).select(f"_h{i}", answer), f"responses-{a.stage}")
            rows = rows.join(answers, f"_h{i}", "left")
        nothing = F.struct(F.lit("").alias("response"), F.lit("skipped").alias("gen_status"), F.lit(None).cast("string").alias("gen_error"))
        filled = rows.withColumns({f"_a{i}": F.coalesce(f"_a{i}", nothing) for i in range(len(asks))}).drop(*hashes)
        return filled, lambda found: self.texts.attach(found, held)

    def ask_bare(self, df: DataFrame, stage: str, prompt: Column, system: str, read: Read) -> Bare:
        if not store_of(self.texts, df):
            return Bare(read(self.ask(df, stage, prompt, system)), lambda rows: rows)
        rows, attach = self._once(df.drop("response", "gen_status", "gen_error"), [Ask(stage, prompt, system, "response")])
        return Bare(read(rows.select(*[c for c in rows.columns if c != "_a0"], "_a0.*")), attach)

    def ask(self, df: DataFrame, stage: str, prompt: Column, system: str = "") -> DataFrame:
        if store_of(self.texts, df):
            kept = df.drop("response", "gen_status", "gen_error")
            rows, attach = self._once(kept, [Ask(stage, prompt, system, "response")])
            return attach(rows).select(*kept.columns, "_a0.*")
        kept = [c for c in df.columns if c not in ("response", "gen_status", "gen_error")]
        answer = _model_udf(self.call, system, self.threads)(prompt)
        answered = self._spread(df).select(*kept, answer.alias("_r")).select(*kept, "_r.*")
        return cut(answered, f"responses-{stage}")

    def ask_all(self, df: DataFrame, asks: Sequence[Ask]) -> DataFrame:
        """All calls of a row in one pass, so the rows are written once and not once per ask."""
        if store_of(self.texts, df):
            rows, attach = self._once(df, asks)
            return attach(rows).select(*df.columns, *[F.col(f"_a{i}.response").alias(a.to) for i, a in enumerate(asks)])
        answers = [_model_udf(self.call, a.system, self.threads)(a.prompt).alias(f"_{a.to}") for a in asks]
        answered = self._spread(df).select(*df.columns, *answers)
        texts = [F.col(f"_{a.to}.response").alias(a.to) for a in asks]
        return cut(answered.select(*df.columns, *texts), f"responses-{asks[0].stage}")

    def _spread(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.partitions) if self.partitions else df


@dataclass(frozen=True)
class RecordingGenerator:
    """Passes on to ``inner`` and keeps what was asked: ``recorded()`` is a response table for ``TableGenerator``.

    Over a text store (its own where ``inner`` has none) the narrow rows of a call are written with their answers, so a later call
    goes on from them and no call is computed again for each one after it. ``ask_bare``, the only call of its flow, writes none;
    a flow with derived texts has this one call and needs no store of its own here. Its responses get places (``PlacedResponses``).
    """

    inner: Generator
    texts: TextStore | None = None
    _parts: list[DataFrame] = field(default_factory=list, repr=False, compare=False)
    _bare: list[DataFrame] = field(default_factory=list, repr=False, compare=False)

    def over(self, df: DataFrame, texts: Mapping[str, str], *derived) -> tuple[Generator, DataFrame]:
        inner, rows = self.inner.over(df, texts, *derived)
        if ROW_KEY in rows.columns:
            return replace(self, inner=inner), rows
        marked = rows.withColumn(ROW_KEY, row_key(rows))
        store = None if derived else TextStore.of(marked, texts)
        return replace(self, inner=inner, texts=store), marked

    def ask_bare(self, df: DataFrame, stage: str, prompt: Column, system: str, read: Read) -> Bare:
        answered = self.inner.ask(df, stage, prompt, system)
        self._bare.append(self._told(answered, stage, prompt_hash(prompt, system), "response"))
        return Bare(read(answered), lambda rows: rows)

    def ask(self, df: DataFrame, stage: str, prompt: Column, system: str = "") -> DataFrame:
        return self._whole(self.inner.ask(df, stage, prompt, system), [Ask(stage, prompt, system, "response")])

    def ask_all(self, df: DataFrame, asks: Sequence[Ask]) -> DataFrame:
        return self._whole(self.inner.ask_all(df, asks), asks)

    def _whole(self, answered: DataFrame, asks: Sequence[Ask]) -> DataFrame:
        rows, attach = self._record(answered, asks)
        return attach(rows).select(*answered.columns)

    def _record(self, answered: DataFrame, asks: Sequence[Ask]) -> tuple[DataFrame, Attach]:
        texts = store_of(self.texts, answered)
        held = texts.held(answered) if texts else []
        hashes = {f"_h{i}": prompt_hash(a.prompt, a.system) for i, a in enumerate(asks)}
        rows = answered.withColumns(hashes)
        rows = cut(texts.detach(rows), f"recorded-{asks[0].stage}") if texts else rows
        self._keep(rows, [(a.stage, F.col(f"_h{i}"), a.to) for i, a in enumerate(asks)])
        return rows.drop(*hashes), lambda found: texts.attach(found, held) if texts else found

    def _keep(self, rows: DataFrame, told: Sequence[tuple[str, Column, str]]) -> None:
        self._parts.extend(self._told(rows, *each) for each in told)

    def _told(self, rows: DataFrame, stage: str, hashed: Column, to: str) -> DataFrame:
        part = rows.select(F.lit(stage).alias("stage"), hashed.alias("prompt_hash"), F.col(to).alias("response"))
        return part.filter("prompt_hash IS NOT NULL")

    def recorded(self) -> DataFrame:
        """(``stage``, ``prompt_hash``, ``response``), one row for each prompt of a stage, written. Those of ``ask_bare`` alone have places too."""
        union = reduce(DataFrame.unionByName, [*self._parts, *self._bare])
        if not self._parts:
            return PlacedResponses.of(union)
        once = union.groupBy("stage", "prompt_hash").agg(F.min("response").alias("response"))
        return cut(once, "recorded-responses")

"""Chat formatting from typed content parts.

A visitor walks the parts of a message in order: text is escaped, images, sounds and documents become numbered
placeholders, and every attachment is recorded with its reference and the tokens it will expand to. Each turn is
formatted on its own, so a conversation of any length needs no gathering; folds over a conversation read its turns in
order as a stream.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from qaspark.llm.common import ship

PART = "kind string, text string, ref string, width int, height int, seconds double, pages int"
SEGMENT = "formatted string, loss array<struct<first:int,end:int>>, attachments array<struct<place:int,kind:string,ref:string,tokens:int>>, tokens int"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<]|\\.|<\|(?:image|audio|document) \d+\|>)*)</turn>\n", re.S)
PLACEHOLDER = re.compile(r"(?<!\\)((?:\\\\)*)<\|(?:image|audio|document) \d+\|>")


def escape(text: str) -> str:
    r"""Reversible: no unescaped ``<`` or ``>`` is left, and every backslash is itself escaped."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class PartVisitor:
    """Flattens the parts of one message; ``tokens`` are those of the attachments, text is counted elsewhere."""

    def __init__(self, patch: int, rate: float, per_page: int) -> None:
        self.patch, self.rate, self.per_page = patch, rate, per_page
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part[side] or 0) / self.patch) for side in ("width", "height"))
        self.attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0.0) * self.rate))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part["pages"] or 0) * self.per_page)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"content part of unknown kind {part['kind']!r}")

    def attach(self, part: dict, tokens: int) -> None:
        place = len(self.attachments)
        self.attachments.append({"place": place, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        self.out.append(f"<|{part['kind']} {place}|>")


@dataclass(frozen=True)
class ChatFormat:
    """Formats turns; only texts of ``learn`` are under the loss mask.

    Input ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored. A null text is empty, a null role is the empty
    role. ``parts`` may name a column of typed parts that replaces the text. Turns are ordered by ``turn`` (null
    first), then role, then text; repeated rows are turns each. Rows with a null ``conv_id`` are one conversation. An
    empty table gives no rows.
    """

    learn: tuple[str, ...] = ("assistant",)
    parts: str | None = None
    patch: int = 14
    rate: float = 25.0
    per_page: int = 256

    def content(self) -> Column:
        if self.parts is not None:
            return F.col(self.parts)
        absent = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
        return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *absent))

    def segments(self, turns: DataFrame) -> DataFrame:
        """A row per turn: ``conv_id``, ``turn``, ``role``, ``formatted``, spans of ``loss``, ``attachments``, their ``tokens``."""
        ship(turns)
        learn, settings = set(self.learn), (self.patch, self.rate, self.per_page)

        @F.pandas_udf(SEGMENT)
        def flatten(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
            out = []
            for role, parts in zip(roles, contents):
                visitor = PartVisitor(*settings)
                for part in parts if parts is not None else ():
                    visitor.visit(part)
                head, body = f"<turn {escape(role)}>", "".join(visitor.out)
                loss = [{"first": len(head), "end": len(head) + len(body)}] if role in learn else []
                out.append((f"{head}{body}</turn>\n", loss, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)))
            return pd.DataFrame(out, columns=["formatted", "loss", "attachments", "tokens"])

        role = F.coalesce("role", F.lit("")).alias("role")
        rows = turns.select("conv_id", "turn", role, self.content().alias("content"), F.coalesce("text", F.lit("")).alias("text") if self.parts is None else F.lit("").alias("text"))
        done = rows.select("conv_id", "turn", "role", "text", flatten("role", "content").alias("s"))
        return done.select("conv_id", "turn", "role", "text", "s.*")

    def read_back(self, segments: DataFrame) -> DataFrame:
        """(``conv_id``, counts and digests) from the formatted output alone.

        Turns of a conversation are one sorted stream; digests are updated turn by turn, so memory does not grow
        with the conversation.
        """

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, known = None, None
            for batch in batches:
                done = []
                for conv, formatted, loss in zip(batch["conv"], batch["formatted"], batch["loss"]):
                    if state is None or conv != known:
                        if state is not None:
                            done.append((known, *state.result()))
                        state, known = Readback(), conv
                    state.add(formatted, [(span["first"], span["end"]) for span in loss])
                if done:
                    yield pd.DataFrame(done, columns=READ)
            if state is not None:
                yield pd.DataFrame([(known, *state.result())], columns=READ)

        conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
        order = ["conv", "turn", "role", "text"]
        stream = segments.select(conv, "turn", "role", "text", "formatted", "loss").repartition("conv").sortWithinPartitions(*order).select("conv", "formatted", "loss")
        found = stream.mapInPandas(fold, "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
        return found.select(F.when(F.col("conv") != "", F.col("conv")).cast("bigint").alias("conv_id"), *READ[1:])


READ = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


class Readback:
    """Parses formatted turns and keeps running digests of what they hold."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, formatted: str, loss: list[tuple[int, int]]) -> None:
        for turn in TURN.finditer(formatted):
            self.n += 1
            role, text = (unescape(PLACEHOLDER.sub(r"\1", x)) for x in turn.groups())
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for first, end in loss:
            text = unescape(PLACEHOLDER.sub(r"\1", formatted[first:end]))
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def result(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

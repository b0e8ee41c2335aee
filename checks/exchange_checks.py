"""Whole flows on stored and on called responses, over all documents.

The stored responses are recorded from a run of the same flow, so each replay finds its answers by the hash of the prompt that it
builds itself. The called model is a Python function that sees the prompt alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from checks.generate_checks import _HOP_OUT, _ALPACA, ATOMIC_SQL, MULTIHOP_FLOW_SQL, N1_SQL, TAXONOMY, steps_text, text_list
from checks.model import model
from checks.registry import REGISTRY, bigs, check, documents, headed_documents
from qaspark.operators.filters import GradeFilter
from qaspark.operators.generation import CallableGenerator, Generator, RecordingGenerator, TableGenerator
from qaspark.operators.prompts import SCORE_TASKS
from qaspark.plans import qa as flows

Flow = Callable[[Generator], DataFrame]


def replayed(flow: Flow, generator: Generator) -> DataFrame:
    """``flow`` on the responses that a first run of it recorded."""
    recorder = RecordingGenerator(generator)
    flow(recorder)
    return flow(TableGenerator(recorder.recorded(), unique=True))


def single_flow(spark, sf) -> Flow:
    return lambda generator: flows.markdown_qa(
        documents(spark, sf), generator, question_num=2, grades=GradeFilter.all_at(1), language="en"
    )["qa_export"]


@check("markdown_qa_stored", "N1 J1 G2 S11", REGISTRY["markdown_qa"].sql)
def markdown_qa_stored(spark, sf):
    return bigs(replayed(single_flow(spark, sf), model("singlehop", "scores")))


@check(
    "atomic_stored",
    "J1 G2 S11 Q4",
    f"WITH {ATOMIC_SQL} SELECT source_md, chunk_index, question AS input, refined AS output, '{_ALPACA}' AS instruction FROM shaped",
)
def atomic_stored(spark, sf):
    flow = lambda generator: flows.markdown_qa(
        documents(spark, sf), generator, kind="atomic", question_num=1, atomic_max_per_task=2, language="en"
    )["qa_export"]
    return bigs(replayed(flow, model("atomic")))


@check("taxonomy_stored", "J1 G2 S11 Q11 Q12 Q13", REGISTRY["markdown_qa_taxonomy"].sql)
def taxonomy_stored(spark, sf):
    flow = lambda generator: flows.markdown_qa(
        documents(spark, sf), generator, kind="taxonomy", taxonomy=TAXONOMY, question_num=1, language="en"
    )["qa_export"]
    return bigs(replayed(flow, model("taxonomy", "scores")))


@check(
    "multihop_stored",
    "J1 G2 S11 Q15 N2",
    f"WITH RECURSIVE {MULTIHOP_FLOW_SQL} SELECT {_HOP_OUT}, complexity FROM hops",
)
def multihop_stored(spark, sf):
    flow = lambda generator: flows.markdown_multihop_qa(
        headed_documents(spark, sf), generator, chunk_words=300, language="en"
    )["qa_multihop_generated"]
    rows = replayed(flow, model("multihop"))
    return bigs(
        rows.select(
            "source_md", "chunk_index", "info_pair_index", "question", "answer", steps_text().alias("steps"),
            text_list("supporting_facts").alias("facts"), "qa_type", "complexity",
        )
    )


def model_call():
    """A model that reads its prompt: instructions, pairs and grades by lengths. Nested, so that workers get it by value."""
    tasks = list(SCORE_TASKS.values())

    def answer(prompt: str) -> str:
        import hashlib
        import json

        if prompt.startswith("Passage:\n"):
            chunk, rest = prompt[len("Passage:\n") :].split("\n\nAsked: ", 1)
            question, rest = rest.split("\nReplied: ", 1)
            reply, task = rest.split("\n\n", 1)
            k = next(i for i, t in enumerate(tasks) if task.startswith(t))
            if (len(question) + k) % 7 == 0:
                return "no grade"
            grade = (len(question) * (k + 1) + len(reply) + len(chunk)) % 5 + 1
            return f"**Grading**: {'3.5' if grade == 3 else grade}\n**Feedback**:  seen {len(reply)}\nend "
        head, chunk = prompt.split("\n\nPassage:\n", 1)
        n = len(chunk)
        if prompt.startswith("Below is a passage."):
            asks = {0: ["Ask who acts", "Ask what follows"], 1: ["Ask who acts", "Ask when"], 2: ["Ask where", "Ask why"]}
            return json.dumps(asks.get(n % 5, []))
        instruction = head.split("\n", 1)[0]
        question, reply = f"{instruction} in {n} characters?", hashlib.md5(chunk.encode()).hexdigest()
        m = (n + len(instruction)) % 4
        if m == 0:
            return json.dumps({"qa_pairs": [{"question": question, "answer": reply}, {"question": question + " More?", "answer": reply + " more"}]})
        return "I cannot." if m == 3 else f"Q: {question}\nA: {reply}"

    def call(prompts: list[str], system: str) -> list[str]:
        return [answer(p) for p in prompts]

    return call


@check("markdown_qa_called", "N1 G0", f"WITH {N1_SQL} SELECT '{_ALPACA}' AS instruction, question AS input, answer AS output, source_md, chunk_index FROM kept")
def markdown_qa_called(spark, sf):
    return bigs(single_flow(spark, sf)(CallableGenerator(model_call(), threads=1)))

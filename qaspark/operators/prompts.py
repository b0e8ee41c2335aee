"""Prompt projections: a template with named places and the columns that fill them.

Our own wording; what matters is which inputs a prompt shows and which response shape it asks for.
``<<name>>`` marks a place, so JSON examples need no escaping. Templates are fixed before the row's
text is put in, whatever the text holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_PLACE = re.compile(r"<<(\w+)>>")


@dataclass(frozen=True)
class Template:
    text: str

    @property
    def places(self) -> list[str]:
        return _PLACE.findall(self.text)

    def render(self, **values: Column | str) -> Column:
        """One ``concat`` of literals and columns; null values count as empty."""
        parts: list[Column] = []
        for i, piece in enumerate(_PLACE.split(self.text)):
            if i % 2 == 0:
                parts.append(F.lit(piece))
            else:
                value = values[piece]
                parts.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("")))
        return F.concat(*parts)


JSON_ONLY = "Answer with valid JSON only, without code fences."

# --- single-hop -----------------------------------------------------------------------------------
META_PROMPT = Template(
    "Below is a passage. Write <<amount>> that each tell a language model to take one question and one short, "
    "checkable answer from this passage. Do not write the questions yourself and do not repeat the passage.\n"
    'Reply with a JSON list of strings: ["...", "..."]\n\nPassage:\n<<chunk>>'
)
SEED_PROMPT = Template("<<instruction>>\nReply in two lines:\nQ: ...\nA: ...\n\nPassage:\n<<chunk>>")


def meta_amount(question_num: int) -> str:
    return "as many different instructions as you can" if question_num == 1 else f"exactly {question_num} different instructions"


# --- atomic ---------------------------------------------------------------------------------------
IDENTIFIER_SYSTEM = (
    "Name the main subject of the text: a proper noun, a technical term or another unique identifier. "
    'Reply as {"content_identifier": "..."}.'
)
IDENTIFIER = Template("Text to name:\n<<text>>\n")
CONCLUSIONS_SYSTEM = (
    "Extract indivisible facts that can be verified: each one needs a number, a date or a unique name, and its "
    "time range where it has one. R says which relation or measure the fact answers. "
    'Reply as [{"conclusion": "...", "R": "..."}].'
)
CONCLUSIONS = Template("Document:\n<<text>>\n")
ATOMIC_QUESTION_SYSTEM = (
    "Write one question that the given fact answers, about the given identifier and relation, without giving "
    'the answer away. Reply as {"Q": "..."}.'
)
ATOMIC_QUESTION = Template("Identifier: <<identifier>>\nFact: <<conclusion>>\nRelation: <<relation>>\n")
ATOMIC_CLEAN_SYSTEM = (
    "Shorten the answer to exactly what the question asks for, keeping numbers, dates and names as they are. "
    'Reply as {"refined_answer": "..."}.'
)
ATOMIC_CLEAN = Template("Item:\n<<item>>\n")
CLOSED_BOOK = Template("Answer from your own knowledge, as briefly as possible.\nQuestion: <<question>>\n")
RECALL_SYSTEM = (
    "Judge whether an answer carries what the reference answer carries. Score 2: the same content, however it is "
    "put. Score 1: everything the reference says and further correct content. Score 0: some essential part of the "
    'reference is absent or contradicted; a partial answer is 0. Reply as {"answer_score": 0}.'
)
RECALL = Template("Reference answer: <<golden>>\nOther answer: <<other>>\n")
ALTERNATIVES_SYSTEM = (
    "Collect the wordings under which this answer could appear. The first element is the answer exactly as given, "
    "every further one says the same in another way. Reply as a JSON list of strings."
)
ALTERNATIVES = Template("Answer: <<answer>>\n")
OPEN_BOOK = Template("Answer from the document only, as briefly as possible.\nDocument:\n<<text>>\n\nQuestion: <<question>>\n")

# --- depth and width ------------------------------------------------------------------------------
SUPERSET_SYSTEM = (
    "Find a broader subject that contains the given one and name the relation between them. "
    'Reply as {"identifier": "...", "relation": "..."}.'
)
SUPERSET = Template("Subject: <<identifier>>\n")
SUPERSET_CHECK_SYSTEM = (
    "Decide whether the broader subject together with the relation points to the narrower subject and to nothing "
    "else. It is invalid when the broader subject does not truly contain the narrower one, when both are names for the "
    "same thing, or when several subjects would fit the relation. "
    'Reply as {"new_query": "valid"} or {"new_query": "invalid"}.'
)
SUPERSET_CHECK = Template("Broader subject: <<superset>>\nRelation: <<relation>>\nNarrower subject: <<identifier>>\n")
DEPTH_QUESTION_SYSTEM = (
    "Write one question about the broader subject and the relation whose answer is the given one. "
    'Reply as {"new_query": "..."}.'
)
DEPTH_QUESTION = Template("Broader subject: <<superset>>\nRelation: <<relation>>\nAnswer: <<identifier>>\n")
DEPTH_ANSWER = Template('Answer from your own knowledge. Reply as {"answer_list": ["..."]}.\nQuestion: <<question>>\n')
WIDTH_MERGE_SYSTEM = (
    "Merge the given questions into one well-formed question that keeps every element of them and adds nothing. "
    'Reply as [{"question": "...", "index": [0, 1], "content_identifier": "..."}].'
)
WIDTH_MERGE = Template("Questions to merge:\n<<items>>\n")
WIDTH_ORIGIN_SYSTEM = (
    "Decide whether the merged question can be taken apart into the original ones without loss: state 1 if so, "
    'else 0. Reply as [{"index": 0, "complex_question": "...", "state": 1}].'
)
WIDTH_ORIGIN = Template("Merged question and originals:\n<<item>>\n")
WIDTH_ANSWER_SYSTEM = (
    "Answer the merged question from your own knowledge. "
    'Reply as [{"index": 0, "complex_question": "...", "llm_answer": "..."}].'
)
WIDTH_ANSWER = Template("Question to answer:\n<<item>>\n")

# --- multi-hop ------------------------------------------------------------------------------------
_MULTIHOP_SHAPE = (
    '{"question": "...", "reasoning_steps": [{"step": "..."}, {"step": "..."}], "answer": "...", '
    '"supporting_facts": ["...", "..."], "type": "..."}'
)
MULTIHOP_SYSTEM = {
    "en": "You write questions that can only be answered by combining two or three facts of a context. Name each "
    "reasoning step, quote the facts word for word, ignore links and references. Reply as " + _MULTIHOP_SHAPE,
    "zh": "你编写必须结合上下文中两到三个事实才能回答的问题。逐步写出推理过程，逐字引用事实，忽略链接和参考文献。按此格式回复："
    + _MULTIHOP_SHAPE,
}
MULTIHOP = {
    "en": Template("Context:\n<<context>>\n\nWrite one multi-hop question from this context in the required JSON shape.\n"),
    "zh": Template("上下文：\n<<context>>\n\n请根据以上上下文写出一个多跳问题，并使用要求的 JSON 格式。\n"),
}


def multihop_system(language: str, extra: str | None = None) -> str:
    base = MULTIHOP_SYSTEM[language]
    return f"{extra.strip()}\n\n{base}" if extra and extra.strip() else base


# --- taxonomy -------------------------------------------------------------------------------------
TAXONOMY_TAGS = Template(
    "You are an expert on <<topic>>. Tag the knowledge points of the context with entries of the catalogue only; "
    "one tag per point, none for covers, indexes or captions.\n<<language>>\n\nCatalogue:\n<<catalog>>\n\n"
    'Reply as {"tags": [{"level1_name": "...", "level2_name": "...", "task_type": "...", "reasoning_style": "..."}]}'
    "\n\nContext:\n<<chunk>>"
)
TAXONOMY_EMPTY = 'The context is empty. Reply as {"tags": []}.'
TAXONOMY_QUESTION = Template(
    "You are an expert on <<topic>>. Write one self-contained question from the context for this tag.\n<<language>>\n"
    "Category: <<level1>> / <<level2>>\nFocus: <<focus>>\nHint: <<hint>>\nTask: <<task>> (<<task_text>>)\n"
    'Reasoning: <<style>> (<<style_text>>)\nReply as {"question": "..."}\n\nContext:\n<<chunk>>'
)
TAXONOMY_ANSWER = Template(
    "You are an expert on <<topic>>. Answer the question from the context only.\n<<language>>\n"
    "Category: <<level1>> / <<level2>>\nTask: <<task>>\nReasoning: <<style>>\n"
    'Reply as {"answer": "..."}\n\nQuestion: <<question>>\n\nContext:\n<<chunk>>'
)


def with_json_rule(system: str) -> str:
    return f"{system.rstrip()}\n\n{JSON_ONLY}" if system else JSON_ONLY


# --- expansion, reasoning, scores -----------------------------------------------------------------
# Expansion modes.
EXPANSION_MODES = ("detail", "contextual", "reasoning")
EXPANSION_HINTS = {
    "detail": "The longer answer may name conditions, figures and causes that the passage states.",
    "contextual": "Someone without the passage should see from the question what it is about; fit the answer to it.",
    "reasoning": "Lead the reader to the answer through the facts it rests on, in two or three sentences.",
}
EXPAND = Template(
    "Passage:\n<<context>>\n\nSomebody asked: <<question>>\nThe reply was: <<answer>>\n\n"
    "Rewrite both so that they say more without saying anything else. <<hint>>\n<<language>>\n"
    'Reply as {"expanded_question": "...", "expanded_answer": "...", "expansion_type": "<<mode>>", '
    '"expansion_notes": "what you changed"}'
)
THINK = Template(
    "Passage:\n<<context>>\n\nAsked: <<question>>\nKnown reply: <<answer>>\n\n"
    "Show how a careful reader gets from the passage to the reply, then give the reply as it follows from that. "
    'A reply that can be read off directly needs no reasoning: use "" then.\n<<language>>\n'
    'Reply as {"think": "...", "answer": "..."}'
)


def grounded_system(task: str, language: str, system: str | None) -> str:
    from qaspark.operators.language import language_instruction

    lead = system.strip() if system else f"{task} What the passage does not support must not appear."
    return f"{lead} {language_instruction(language)} {JSON_ONLY}"


SCORE_TASKS = {
    "question_quality": "Could a reader act on this question alone, and is it worth asking?",
    "answer_alignment": "Is this reply about what was asked, all of it and no more?",
    "answer_verifiability": "Can each statement of the reply be pointed to in the passage?",
    "downstream_value": "Would a model or a search index be better for having seen this pair?",
}
SCORE = Template(
    "Passage:\n<<context>>\n\nAsked: <<question>>\nReplied: <<answer>>\n\n<<task>> Give a whole number, 5 for a clear "
    "yes down to 1 for a clear no, and one sentence of reason.\n<<language>>\n"
    "Use these two lines:\n**Grading**: number\n**Feedback**: sentence"
)

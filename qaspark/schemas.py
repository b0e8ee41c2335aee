"""Column sets of the stage tables. A null column stands for an absent field."""

from __future__ import annotations

# Types are written as DDL text, so importing this module needs no session.
STEPS = "array<struct<step:string>>"

CHUNK = "source_md string, chunk_index int, chunk_text string"

MANIFEST = {
    "source_path": "string",
    "output_md_path": "string",
    "status": "string",
    "parser": "string",
    "error_code": "string",
    "sha256": "string",
    "mineru_version": "string",
    "mineru_backend": "string",
    "source_kind": "string",
    "url_host": "string",
    "url_fingerprint": "string",
    "duration_ms": "bigint",
    "stderr_tail": "string",
    "error_detail": "string",
}

TAGS = (
    "array<struct<level1_name:string,level2_name:string,task_type:string,reasoning_style:string,"
    "focus:string,prompt_hint:string>>"
)

QA = (
    "source_md string, chunk_index int, rec_ord array<int>, question string, answer string, context string, "
    "hop_type string, reasoning_steps array<struct<step:string>>, supporting_facts array<string>, qa_type string"
)

RESPONSES = "stage string, prompt_hash string, response string"

# The four score dimensions, in order.
DIMENSIONS = ("question_quality", "answer_alignment", "answer_verifiability", "downstream_value")

# Record fields stored as columns of the review table; all others stay in its JSON text.
HOT_FIELDS = (
    "question",
    "answer",
    "chunk_text",
    "expanded_question",
    "expanded_answer",
    "hop_type",
    "level1_name",
    "level2_name",
    "task_type",
    "question_quality_grade",
    "answer_alignment_grade",
    "answer_verifiability_grade",
    "downstream_value_grade",
)
GRADE_FIELDS = tuple(f"{d}_grade" for d in DIMENSIONS)

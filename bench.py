"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. Each query is planned and
run into the ``noop`` sink, which computes every row and column; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from checks import REGISTRY
from qaspark.session import local_session

HEADLINE = (
    "word_chunks",
    "semantic_chunks",
    "multihop_contexts",
    "singlehop_qa",
    "markdown_qa",
    "markdown_qa_edited",
    "markdown_qa_atomic",
    "markdown_qa_taxonomy",
    "multihop_qa",
    "markdown_multihop_qa",
    "score_qa",
    "depth_qa",
    "width_qa",
    "token_f1",
    "first_by_question",
    "limit_per_chunk",
    "session_items",
    "stage_events",
    "upsert_items",
    "context_reattach",
    "ingest_outcomes",
    "url_manifest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.read.parquet(f"{sf}/documents.parquet").count()  # the JVM and the scan classes are loaded
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.time()
            REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(min(runs), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()

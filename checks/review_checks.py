"""The review store: jobs from event users, items from conversations and document lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.generate_checks import GRADES, scores_sql, expand_sql
from checks.model import model
from checks.registry import PAIRS_SQL, bigs, check, conversation_pairs, micros, table
from checks.table_checks import LINES_SQL, lines
from qaspark.operators import review as R


def jobs(spark, sf):
    """One job per user of the event log."""
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n"), F.max("event_type").alias("last_type")
    )
    return per_user.select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"),
        micros("created_at").alias("created_at"),
        F.when(F.col("n") % 3 == 0, F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        F.when(F.col("n") % 2 == 0, F.lit("multihop")).otherwise(F.lit("singlehop")).alias("pipeline"),
        F.when(F.col("n") % 5 == 0, F.lit("atomic")).when(F.col("n") % 5 == 1, F.lit("taxonomy")).alias("generator"),
    )


JOBS_SQL = (
    "jobs AS (SELECT 'job-' || user_id AS job_id, epoch_us(min(ts)) AS created_at, CASE WHEN count(*) % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status, "
    "CASE WHEN count(*) % 2 = 0 THEN 'multihop' ELSE 'singlehop' END AS pipeline, "
    "CASE count(*) % 5 WHEN 0 THEN 'atomic' WHEN 1 THEN 'taxonomy' END AS generator FROM events GROUP BY user_id)"
)


@check("result_stage", "R11", f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN pipeline = 'multihop' THEN 'qa_multihop_generated' "
       "WHEN generator = 'atomic' THEN 'atomic/qa_generated' ELSE coalesce(generator, 'default') || '/qa_scored' END AS result_stage FROM jobs")
def result_stage(spark, sf):
    return R.result_stage(jobs(spark, sf)).select("job_id", "result_stage")


@check(
    "job_page",
    "O2",
    f"WITH {JOBS_SQL} SELECT job_id, created_at FROM jobs WHERE status = 'succeeded' ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 10",
)
def job_page(spark, sf):
    return R.job_page(jobs(spark, sf), "succeeded", limit=25, offset=10).select("job_id", "created_at")


@check(
    "stage_events",
    "R12",
    "SELECT 'job-' || user_id AS job_id, event_id, event_type AS stage, epoch_us(lead(ts) OVER w) AS next_us, "
    "round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 6)::DOUBLE AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def stage_events(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"), "event_id", F.col("event_type").alias("stage"), F.col("ts").alias("created_at")
    )
    timed = R.stage_durations(log)
    return bigs(timed.select("job_id", "event_id", "stage", micros("next_at").alias("next_us"), "seconds"))


@check(
    "session_items",
    "R1 F4",
    f"WITH {LINES_SQL}, r AS (SELECT d.lang AS session_id, l.source_md, line_no, line FROM lines l JOIN documents d ON 'doc-' || d.doc_id = l.source_md), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY source_md, line_no) - 1 AS sort_index FROM r) "
    "SELECT session_id, 'qa-' || sort_index AS id, sort_index, source_md, line_no, length(line) % 5 + 1 >= 3 AS filter_passed, false AS deleted FROM n",
)
def session_items(spark, sf):
    """Sessions by language: one of them holds most of the lines."""
    langs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_md"), F.col("lang").alias("session_id"))
    records = lines(spark, sf).join(langs, "source_md").withColumn("question_quality_grade", (F.length("line") % 5 + 1).cast("double"))
    items = R.session_items(records, 3.0, ("source_md", "line_no"))
    return bigs(items.select("session_id", "id", "sort_index", "source_md", "line_no", "filter_passed", "deleted"))


@check(
    "upsert_items",
    "R2",
    "SELECT user_id::VARCHAR AS session_id, event_type AS id, arg_max(value, epoch_us(ts)) AS value, arg_max(props, epoch_us(ts)) AS props, "
    "max(epoch_us(ts)) AS updated_at, min(epoch_us(ts)) AS created_at FROM events GROUP BY ALL",
)
def upsert_items(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("id"), "value", "props",
        micros("ts").alias("updated_at"), micros("ts").alias("created_at"),
    )
    return bigs(R.upsert(log.filter("value < 10"), log.filter("value >= 10")))


@check(
    "replace_sessions",
    "R3",
    f"WITH {PAIRS_SQL}, long AS (SELECT source_md FROM qa GROUP BY 1 HAVING count(*) > 2) "
    "SELECT source_md AS session_id, chunk_index::VARCHAR AS id, question AS text FROM qa WHERE source_md NOT IN (SELECT source_md FROM long) "
    "UNION ALL SELECT source_md, 'new-' || chunk_index, answer FROM qa WHERE source_md IN (SELECT source_md FROM long)",
)
def replace_sessions(spark, sf):
    pairs = conversation_pairs(spark, sf).withColumnRenamed("source_md", "session_id")
    long = pairs.groupBy("session_id").count().filter("count > 2").select("session_id")
    current = pairs.select("session_id", F.col("chunk_index").cast("string").alias("id"), F.col("question").alias("text"))
    new = pairs.join(long, "session_id").select(
        "session_id", F.concat(F.lit("new-"), "chunk_index").alias("id"), F.col("answer").alias("text")
    )
    return R.replace_sessions(current, new)


def items(spark, sf):
    """Review items of the conversation pairs, record as hot columns and JSON text."""
    pairs = conversation_pairs(spark, sf)
    records = pairs.withColumns(
        {
            "question_quality_grade": (F.length("question") % 5 + 1).cast("double"),
            "note": F.concat(F.lit("n"), F.length("answer")),
            "session_id": F.col("source_md"),
            "id": F.concat(F.lit("qa-"), "chunk_index"),
            "deleted": F.length("question") % 9 == 0,
            "dirty": F.length("answer") % 2 == 0,
            "selected": F.lit(False),
            "user_modified": F.lit(False),
            "filter_passed": F.lit(None).cast("boolean"),
        }
    )
    fields = ["question", "answer", "chunk_text", "question_quality_grade", "note"]
    return R.split_record(records, fields, ["session_id", "id", *R.FLAGS])


@check(
    "patch_items",
    "R4",
    f"WITH {PAIRS_SQL}, i AS (SELECT *, length(question) % 3 AS k FROM qa) SELECT source_md AS session_id, 'qa-' || chunk_index AS id, "
    "CASE WHEN k = 0 THEN 'edited ' || length(question) ELSE question END AS question, CASE WHEN k <> 0 THEN answer END AS answer, "
    "'n' || length(answer) AS note, CASE WHEN k = 0 THEN 'x' END AS extra, k = 0 AS user_modified, k < 2 OR length(answer) % 2 = 0 AS dirty, "
    "CASE WHEN k = 1 THEN false END AS filter_passed, length(question) % 5 + 1.0::DOUBLE AS grade FROM i",
)
def patch_items(spark, sf):
    rows = items(spark, sf)
    k = F.length("question") % 3
    patch = F.to_json(
        F.struct(F.concat(F.lit("edited "), F.length("question")).alias("question"), F.lit(None).cast("string").alias("answer"), F.lit("x").alias("extra")),
        {"ignoreNullFields": "false"},
    )
    patches = rows.filter(k < 2).select(
        "session_id", "id", F.when(k == 0, patch).alias("record_patch"), F.when(k == 1, F.lit(False)).alias("filter_passed")
    )
    done = R.patch_items(rows, patches)
    return bigs(
        done.select(
            "session_id", "id", "question", "answer", R.merged_field("note").alias("note"), R.merged_field("extra").alias("extra"),
            "user_modified", "dirty", "filter_passed", F.col("question_quality_grade").alias("grade"),
        )
    )


@check(
    "soft_delete",
    "R5",
    f"WITH {PAIRS_SQL} SELECT source_md AS session_id, 'qa-' || chunk_index AS id, length(question) % 9 = 0 OR length(answer) < length(question) AS deleted, "
    "length(answer) % 2 = 0 OR length(answer) < length(question) AS dirty FROM qa",
)
def soft_delete(spark, sf):
    rows = items(spark, sf)
    ids = rows.filter(F.length("answer") < F.length("question")).select("session_id", "id")
    return R.soft_delete(rows, ids).select("session_id", "id", "deleted", "dirty")


@check(
    "record_merge",
    "R6",
    f"WITH {PAIRS_SQL} SELECT source_md AS session_id, 'qa-' || chunk_index AS id, CASE WHEN length(question) % 2 = 0 THEN 'hot' ELSE question END AS question, "
    "answer, NULL::VARCHAR AS hop_type, (length(question) % 5 + 1)::DOUBLE AS grade, 'n' || length(answer) AS note FROM qa",
)
def record_merge(spark, sf):
    rows = items(spark, sf).withColumns(
        {
            "question": F.when(F.length("question") % 2 == 0, F.lit("hot")),
            "answer": F.lit(None).cast("string"),
            "question_quality_grade": F.lit(None).cast("double"),
        }
    )
    merged = R.merge_record(rows)
    return merged.select(
        "session_id", "id", "question", "answer", "hop_type", F.col("question_quality_grade").alias("grade"), R.merged_field("note").alias("note")
    )


@check(
    "flag_encoding",
    "R7",
    "SELECT doc_id, (CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 END)::BIGINT AS code, quality = 1 AS flag FROM documents LEFT JOIN labels USING (doc_id)",
)
def flag_encoding(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    coded = rows.select("doc_id", R.flag_code(F.col("quality") == 1).alias("code"))
    return bigs(coded.withColumn("flag", R.code_flag(F.col("code"))))


@check(
    "job_create",
    "R8",
    "WITH req AS (SELECT event_id AS job_id, CASE WHEN event_type <> 'view' THEN props END AS k, epoch_us(ts) AS created_at FROM events WHERE event_type <> 'error'), "
    "old AS (SELECT DISTINCT props AS k FROM events WHERE event_type = 'error' AND value > 20) "
    "SELECT job_id, k AS idempotency_key, created_at FROM req WHERE k IS NULL UNION ALL SELECT job_id, k, created_at FROM "
    "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at, job_id) AS rn FROM req WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM old)) WHERE rn = 1",
)
def job_create(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), "event_type", "value", "props", micros("ts").alias("created_at")
    )
    requests = events.filter("event_type <> 'error'").select(
        "job_id", F.when(F.col("event_type") != "view", F.col("props")).alias("idempotency_key"), "created_at"
    )
    existing = events.filter("event_type = 'error' AND value > 20").select(F.col("props").alias("idempotency_key"))
    return R.create_jobs(existing, requests)


@check(
    "cascade_delete",
    "R9",
    f"WITH {JOBS_SQL}, s AS (SELECT DISTINCT 'conv-' || conv_id AS session_id, 'job-' || conv_id AS job_id FROM conversations), "
    "gone AS (SELECT job_id FROM jobs WHERE status = 'failed') SELECT 'jobs' AS tbl, job_id AS id FROM jobs WHERE job_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'sessions', session_id FROM s WHERE job_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'items', 'conv-' || conv_id || '/' || turn FROM conversations WHERE 'job-' || conv_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'events', event_id::VARCHAR FROM events WHERE 'job-' || user_id NOT IN (FROM gone)",
)
def cascade_delete(spark, sf):
    turns = table(spark, sf, "conversations")
    session = F.concat(F.lit("conv-"), "conv_id")
    store = R.StoreTables(
        jobs=jobs(spark, sf),
        sessions=turns.select(session.alias("session_id"), F.concat(F.lit("job-"), "conv_id").alias("job_id")).distinct(),
        items=turns.select(session.alias("session_id"), F.concat(session, F.lit("/"), "turn").alias("id")),
        events=table(spark, sf, "events").select(F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_id").cast("string").alias("id")),
    )
    left = R.delete_jobs(store, store.jobs.filter("status = 'failed'"))
    parts = [
        left.jobs.select(F.lit("jobs").alias("tbl"), F.col("job_id").alias("id")),
        left.sessions.select(F.lit("sessions").alias("tbl"), F.col("session_id").alias("id")),
        left.items.select(F.lit("items").alias("tbl"), "id"),
        left.events.select(F.lit("events").alias("tbl"), "id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@check(
    "rescore_edited",
    "R10 Q23",
    f"WITH {PAIRS_SQL}, {scores_sql('qa')} SELECT source_md AS session_id, 'qa-' || chunk_index AS id, {', '.join(GRADES)}, "
    f"{' AND '.join(g + ' >= 2' for g in GRADES)} AS filter_passed, true AS dirty FROM scored WHERE length(answer) % 2 = 0 AND length(question) % 9 <> 0",
)
def rescore_edited(spark, sf):
    rows = items(spark, sf).withColumns({"context": F.col("chunk_text"), "chunk_text": F.lit("")})
    return R.rescore_edited(rows, model("scores"), 2.0, "en").select("session_id", "id", *GRADES, "filter_passed", "dirty")


@check(
    "expand_edited",
    "R10 Q21",
    f"WITH {PAIRS_SQL}, {expand_sql('qa')} SELECT source_md AS session_id, 'qa-' || chunk_index AS id, expanded_question, expansion_status, true AS dirty "
    "FROM expanded WHERE length(answer) % 2 = 0 AND length(question) % 9 <> 0",
)
def expand_edited(spark, sf):
    done = R.expand_edited(items(spark, sf), model("edits"), "detail", "en")
    return done.select("session_id", "id", "expanded_question", "expansion_status", "dirty")


@check(
    "rescore_upsert_patch",
    "R2 R4 R10",
    f"WITH {PAIRS_SQL}, {scores_sql('qa')} SELECT source_md AS session_id, 'qa-' || chunk_index AS id, "
    + ", ".join(f"CASE WHEN hit THEN {g} WHEN '{g}' = 'question_quality_grade' THEN length(question) % 5 + 1.0 END::DOUBLE AS {g}" for g in GRADES)
    + ", hit AS kept_feedback, 'p' || length(answer) AS extra FROM "
    "(SELECT *, length(answer) % 2 = 0 AND length(question) % 9 <> 0 AS hit FROM scored)",
)
def rescore_upsert_patch(spark, sf):
    """Scored again, stored, then patched: grades and feedback survive the patch."""
    rows = items(spark, sf).withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    again = R.as_versions(R.rescore_edited(rows, model("scores"), 2.0, "en"), rows)
    later = again.withColumn("updated_at", F.lit(2))
    stored = R.upsert(rows, later)
    patch = F.to_json(F.struct(F.concat(F.lit("p"), F.length("answer").cast("string")).alias("extra")))
    patches = stored.select("session_id", "id", patch.alias("record_patch"))
    done = R.patch_items(stored, patches)
    feedback = F.get_json_object("record_json", f"$.{GRADES[0].removesuffix('_grade')}_feedback").isNotNull()
    return bigs(done.select("session_id", "id", *GRADES, feedback.alias("kept_feedback"), R.merged_field("extra").alias("extra")))


@check(
    "expand_upsert_patch",
    "R2 R4 R10",
    f"WITH {PAIRS_SQL}, {expand_sql('qa')} SELECT source_md AS session_id, 'qa-' || chunk_index AS id, "
    "CASE WHEN hit THEN expanded_question END AS expanded_question, CASE WHEN hit THEN expansion_status END AS expansion_status, 'p' AS extra "
    "FROM (SELECT *, length(answer) % 2 = 0 AND length(question) % 9 <> 0 AS hit FROM expanded)",
)
def expand_upsert_patch(spark, sf):
    """Expanded again, stored, then patched: the expansion survives the patch."""
    rows = items(spark, sf).withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    again = R.as_versions(R.expand_edited(rows, model("edits"), "detail", "en"), rows)
    stored = R.upsert(rows, again.withColumn("updated_at", F.lit(2)))
    done = R.patch_items(stored, stored.select("session_id", "id", F.lit('{"extra":"p"}').alias("record_patch")))
    return done.select("session_id", "id", R.merged_field("expanded_question").alias("expanded_question"), R.merged_field("expansion_status").alias("expansion_status"), R.merged_field("extra").alias("extra"))


@check(
    "qa_counts",
    "A8",
    f"WITH {PAIRS_SQL}, j AS (SELECT DISTINCT conv_id FROM conversations) SELECT 'job-' || j.conv_id AS job_id, count(qa.source_md) AS qa_count "
    "FROM j LEFT JOIN qa ON qa.source_md = 'conv-' || j.conv_id AND length(qa.question) % 2 = 0 GROUP BY 1",
)
def qa_counts(spark, sf):
    rows = items(spark, sf).filter(F.length("question") % 2 == 0)  # some sessions are left without items
    sessions = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.concat(F.lit("job-"), "conv_id").alias("job_id")
    ).distinct()
    return bigs(R.qa_counts(rows, sessions))


@check(
    "item_page",
    "O3",
    f"WITH {LINES_SQL}, r AS (SELECT d.lang AS session_id, l.source_md, line_no FROM lines l JOIN documents d ON 'doc-' || d.doc_id = l.source_md), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY source_md, line_no) - 1 AS sort_index FROM r) "
    "SELECT sort_index, source_md, line_no FROM n WHERE session_id = 'en' AND sort_index % 2 = 0 ORDER BY sort_index LIMIT 40 OFFSET 20",
)
def item_page(spark, sf):
    langs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_md"), F.col("lang").alias("session_id"))
    rows = R.session_items(lines(spark, sf).join(langs, "source_md"), 3.0, ("source_md", "line_no"))
    flagged = rows.withColumn("deleted", F.col("sort_index") % 2 == 1)
    return bigs(R.item_page(flagged, "en", limit=40, offset=20).select("sort_index", "source_md", "line_no"))


@check("record_page", "O4", f"WITH {LINES_SQL} SELECT source_md, line_no, line FROM lines ORDER BY source_md, line_no LIMIT 30 OFFSET 100")
def record_page(spark, sf):
    return bigs(R.record_page(lines(spark, sf), ["source_md", "line_no"], limit=30, offset=100))


@check(
    "question_search",
    "R15",
    f"WITH {PAIRS_SQL} SELECT source_md AS session_id, 'qa-' || chunk_index AS id FROM qa WHERE contains(lower(question), 'the') OR contains(lower(answer), 'the')",
)
def question_search(spark, sf):
    return R.search_questions(items(spark, sf), "THE").select("session_id", "id")


@check(
    "legacy_import",
    "R13",
    "WITH j AS (SELECT 'job-' || conv_id AS job_id, 'up-' || (conv_id // 3) AS upload_id, min(text) AS source_file_name, count(*) AS n FROM conversations GROUP BY conv_id), "
    "have AS (SELECT DISTINCT 'job-' || conv_id AS job_id FROM conversations WHERE role = 'system'), "
    "new_jobs AS (SELECT * FROM j WHERE job_id NOT IN (FROM have)), named AS (SELECT DISTINCT 'up-' || doc_id AS upload_id, lang = 'en' AS described, n_chars FROM documents), "
    "s AS (SELECT DISTINCT 's-' || user_id || '-' || event_type AS session_id, 'job-' || user_id AS job_id, event_type FROM events WHERE 'job-' || user_id IN (SELECT job_id FROM j)) "
    "SELECT 'jobs' AS tbl, job_id AS id, upload_id AS link, '{\"names\":[\"' || job_id || '\"],\"turns\":' || n || '}' AS params, '{\"export\":\"jobs/' || job_id || '/qa.jsonl\"}' AS more, "
    "(SELECT max(session_id) FROM s WHERE s.job_id = new_jobs.job_id) AS session FROM new_jobs "
    "UNION ALL SELECT 'uploads', upload_id, CASE WHEN described THEN upload_id || '.md' ELSE 'document.md' END, CASE WHEN described THEN n_chars ELSE 0 END::VARCHAR, 'uploads/' || upload_id || '/doc.md', NULL FROM named "
    "UNION ALL SELECT 'uploads', upload_id, min_by(source_file_name, job_id), '0', 'uploads/' || upload_id || '/doc.md', NULL FROM new_jobs WHERE upload_id NOT IN (SELECT upload_id FROM named) GROUP BY upload_id "
    "UNION ALL SELECT 'sessions', session_id, job_id, CASE WHEN event_type = 'click' THEN '{\"kind\":\"click\"}' ELSE '{}' END, 'singlehop', NULL FROM s "
    "UNION ALL SELECT 'items', 'qa-' || k, session_id, NULL, '{\"question\":\"' || event_type || k || '\"}', session_id || '@' || k FROM s, unnest([0, 1]) AS u(k) "
    "UNION ALL SELECT 'links', job_id, max(session_id), NULL, NULL, NULL FROM s GROUP BY job_id",
)
def legacy_import(spark, sf):
    """Upload folders with and without metadata, jobs with free-form fields, several sessions of one job."""
    turns, docs = table(spark, sf, "conversations"), table(spark, sf, "documents")
    text = F.lit(None).cast("string")
    job = F.concat(F.lit("job-"), "conv_id")
    old_jobs = turns.groupBy("conv_id").agg(F.min("text").alias("source_file_name"), F.count(F.lit(1)).alias("n")).select(
        job.alias("job_id"), F.concat(F.lit("up-"), F.expr("conv_id div 3")).alias("upload_id"), text.alias("session_id"), "source_file_name",
        F.parse_json(F.to_json(F.struct(F.col("n").alias("turns"), F.array(job).alias("names")))).alias("params"),
        F.parse_json(F.to_json(F.struct(F.concat(F.lit("jobs/"), job, F.lit("/qa.jsonl")).alias("export")))).alias("result_paths"),
        F.lit("2024").alias("created_at"), text.alias("finished_at"),
    )
    described = F.col("lang") == "en"
    folder = F.concat(F.lit("up-"), "doc_id")
    uploads = docs.select(
        folder.alias("upload_id"), F.when(described, F.concat(folder, F.lit(".md"))).alias("fileName"), F.when(described, F.col("n_chars").cast("bigint")).alias("size"), text.alias("createdAt")
    )
    item = lambda k: F.struct(F.lit(f"qa-{k}").alias("id"), F.to_json(F.struct(F.concat("event_type", F.lit(k)).alias("question"))).alias("record"))
    params = F.when(F.col("event_type") == "click", F.parse_json(F.lit('{"kind": "click"}'))).otherwise(F.parse_json(F.lit("[]")))
    sessions = table(spark, sf, "events").select("user_id", "event_type").distinct().select(
        F.concat(F.lit("s-"), "user_id", F.lit("-"), "event_type").alias("session_id"), F.concat(F.lit("job-"), "user_id").alias("jobId"),
        *[text.alias(c) for c in ("sourceFileName", "pipeline", "generator", "createdAt", "updatedAt")], params.alias("params"), F.array(item(0), item(1)).alias("items"),
    )
    have = {
        "jobs": turns.filter("role = 'system'").select(job.alias("job_id")).distinct(),
        "uploads": uploads.select("upload_id").filter(F.lit(False)),
        "sessions": sessions.select("session_id").filter(F.lit(False)),
    }
    new = R.import_legacy(uploads, old_jobs, sessions, have)
    shown = {
        "jobs": ("job_id", "upload_id", "params_json", "result_paths_json", "session_id"),
        "uploads": ("upload_id", "file_name", F.col("size_bytes").cast("string"), "storage_path", text),
        "sessions": ("session_id", "job_id", "params_json", "pipeline", text),
        "items": ("id", "session_id", text, "record", F.concat("session_id", F.lit("@"), "sort_index")),
        "job_sessions": ("job_id", "session_id", text, text, text),
    }
    parts = [new[k].select(F.lit("links" if k == "job_sessions" else k), *v).toDF("tbl", "id", "link", "params", "more", "session") for k, v in shown.items()]
    return reduce(DataFrame.unionByName, parts)

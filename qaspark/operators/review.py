"""The review store as tables: items with flags, change logs, paged views, cascades.

Nothing is updated in place. A change is a new row version, the current state is the latest version of
each key, and the latest version is found by an aggregate that Spark combines before the shuffle, so
an item changed a million times does not load one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qaspark.functions.text import first_filled, let, utc_now
from qaspark.operators.base import first_per_group, join_small, require
from qaspark.operators.expand import ExpandQA
from qaspark.operators.filters import review_flag
from qaspark.operators.generation import Generator
from qaspark.operators.ordering import dense_index_in_group, next_in_group
from qaspark.operators.score import ScoreQA
from qaspark.schemas import GRADE_FIELDS, HOT_FIELDS

ITEM_KEY = ("session_id", "id")
FLAGS = ("deleted", "dirty", "selected", "filter_passed", "user_modified")


def session_items(records: DataFrame, min_score: float, order: tuple[str, ...]) -> DataFrame:
    """Items of a session from its records: ``id`` is ``qa-`` and the position, flags start false.

    The position is dense per session and computed by many tasks even when one session holds most rows.
    """
    numbered = dense_index_in_group(records, ["session_id"], list(order), "sort_index")
    return numbered.withColumns(
        {
            "id": F.concat(F.lit("qa-"), F.col("sort_index").cast("string")),
            "deleted": F.lit(False),
            "dirty": F.lit(False),
            "selected": F.lit(False),
            "filter_passed": review_flag(records, min_score),
            "user_modified": F.lit(False),
        }
    )


def split_record(records: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, the hot fields as columns, and all ``fields`` as JSON text."""
    hot = [F.col(f) if f in fields else F.lit(None).cast("double" if f in GRADE_FIELDS else "string").alias(f) for f in HOT_FIELDS]
    return records.select(*keep, *hot, F.to_json(F.struct(*fields)).alias("record_json"))


def merged_field(name: str) -> Column:
    """Value of a record field: the hot column where it is not null, else the JSON text's own value."""
    stored = F.try_variant_get(F.try_parse_json("record_json"), f"$.{name}", "double" if name in GRADE_FIELDS else "string")
    return F.coalesce(F.col(name), stored) if name in HOT_FIELDS else stored


def merge_record(items: DataFrame) -> DataFrame:
    return items.withColumns({f: merged_field(f) for f in HOT_FIELDS})


def flag_code(flag: Column) -> Column:
    """1, 0 or null of a three-valued flag."""
    return F.when(flag, F.lit(1)).when(~flag, F.lit(0))


def code_flag(code: Column) -> Column:
    return code != 0


def latest(log: DataFrame, keys: tuple[str, ...] = ITEM_KEY, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Latest version of each key, with the earliest ``created_at`` of all its versions.

    ``order`` should tell versions apart; where it ties, the larger row by its columns wins, so the result is defined.
    """
    payload = [c for c in log.columns if c not in (*keys, "created_at")]
    newest = log.groupBy(*keys).agg(
        F.max(F.struct(F.struct(*order).alias("_o"), F.struct(*payload).alias("_p"))).getField("_p").alias("_r"), F.min("created_at").alias("created_at")
    )
    return newest.select(*keys, "_r.*", "created_at").select(*log.columns)


def upsert(current: DataFrame, changes: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Changed rows replace current ones of the same key; creation times stay."""
    return latest(current.unionByName(changes), order=order)


def replace_sessions(current: DataFrame, items: DataFrame) -> DataFrame:
    """All items of every session named in ``items`` are replaced; other sessions stay."""
    replaced = items.select("session_id").distinct()
    return join_small(current, replaced, ["session_id"], "left_anti").unionByName(items)


def _members(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def merge_json(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects; members of the patch win, explicit nulls included."""
    nothing = F.from_json(F.lit("{}"), "map<string,variant>")
    old, new = F.coalesce(_members(base), nothing), F.coalesce(_members(patch), nothing)
    merged = let(
        F.struct(old.alias("old"), new.alias("new")),
        lambda p: F.map_concat(F.map_filter(p.old, lambda k, _: ~F.map_contains_key(p.new, k)), p.new),
    )
    return F.to_json(merged)


def patch_items(items: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply at most one patch per item: ``record_patch`` (JSON object or null) and flag columns (null: keep).

    A patch is applied to the item as it is now: hot columns that are not null stand for their fields, as in
    ``merge_record``, so grades and expansions made since the text was stored survive. A record patch marks the item as
    user-modified, any patch marks it dirty. Keys are unique on both sides, so the join cannot be skewed.
    """
    flags = [f for f in ("deleted", "selected", "filter_passed") if f in patches.columns]
    renamed = patches.select(*ITEM_KEY, "record_patch", *[F.col(f).alias(f"_{f}") for f in flags], F.lit(True).alias("_hit"))
    joined = items.join(renamed, list(ITEM_KEY), "left")
    edited = F.coalesce(F.length("record_patch") > 0, F.lit(False)) & (F.col("record_patch") != "{}")
    marked = F.lit('{"user_modified":true}')
    # null columns are left out of the text, so they change nothing
    hot_now = F.to_json(F.struct(*[c for c in HOT_FIELDS if c in items.columns]))
    present = merge_json(F.col("record_json"), hot_now)
    record = F.when(edited, merge_json(merge_json(present, F.col("record_patch")), marked))
    merged = joined.withColumn("_record", record)
    value = F.try_parse_json("_record")

    def hot(name: str) -> Column:
        kind = "double" if name in GRADE_FIELDS else "string"
        return F.when(edited, F.try_variant_get(value, f"$.{name}", kind)).otherwise(F.col(name))

    return merged.withColumns(
        {
            **{name: hot(name) for name in HOT_FIELDS if name in items.columns},
            "record_json": F.coalesce("_record", "record_json"),
            **{f: F.coalesce(f"_{f}", f) for f in flags},
            "user_modified": edited | F.col("user_modified"),
            "dirty": F.col("dirty") | F.coalesce("_hit", F.lit(False)),
        }
    ).select(*items.columns)


def soft_delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed items become deleted and dirty; nothing is removed."""
    hit = ids.select(*ITEM_KEY).distinct().withColumn("_hit", F.lit(True))
    joined = join_small(items, hit, list(ITEM_KEY), "left")
    flagged = F.coalesce("_hit", F.lit(False))
    return joined.withColumns({"deleted": F.col("deleted") | flagged, "dirty": F.col("dirty") | flagged}).select(*items.columns)


def create_jobs(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """New jobs of ``requests``: a key seen before gives no second job, requests without a key always do."""
    keyed = requests.filter(F.coalesce("idempotency_key", F.lit("")) != "")
    free = requests.filter(F.coalesce("idempotency_key", F.lit("")) == "")
    unseen = join_small(keyed, existing.select("idempotency_key").distinct(), ["idempotency_key"], "left_anti")
    first = first_per_group(unseen, ["idempotency_key"], ["created_at", "job_id"], 1)
    return free.unionByName(first.select(*free.columns))


@dataclass(frozen=True)
class StoreTables:
    jobs: DataFrame
    sessions: DataFrame
    items: DataFrame
    events: DataFrame


def delete_jobs(store: StoreTables, job_ids: DataFrame) -> StoreTables:
    """Jobs go with their sessions, the sessions' items and the jobs' events."""
    gone = job_ids.select("job_id").distinct()
    sessions_gone = join_small(store.sessions, gone, ["job_id"], "left_semi").select("session_id")
    return StoreTables(
        jobs=join_small(store.jobs, gone, ["job_id"], "left_anti"),
        sessions=join_small(store.sessions, gone, ["job_id"], "left_anti"),
        items=join_small(store.items, sessions_gone, ["session_id"], "left_anti"),
        events=join_small(store.events, gone, ["job_id"], "left_anti"),
    )


def rescore_edited(items: DataFrame, generator: Generator, min_score: float, language: str = "zh") -> DataFrame:
    """New versions of edited, undeleted items: scored again, pass flag renewed."""
    edited = items.filter(F.col("dirty") & ~F.col("deleted"))
    old = [c for c in edited.columns if c.endswith("_feedback")]
    context = F.col("context") if "context" in edited.columns else F.lit(None).cast("string")
    with_text = edited.withColumn("chunk_text", first_filled(F.col("chunk_text"), context, F.col("chunk_text")))
    scored = ScoreQA(generator, language)(with_text.drop(*old))
    return scored.withColumns({"filter_passed": review_flag(scored, min_score), "dirty": F.lit(True)})


def expand_edited(items: DataFrame, generator: Generator, mode: str = "detail", language: str = "zh") -> DataFrame:
    """New versions of edited, undeleted items: expanded again."""
    edited = items.filter(F.col("dirty") & ~F.col("deleted"))
    return ExpandQA(generator, mode, language)(edited).withColumn("dirty", F.lit(True))


def result_stage(jobs: DataFrame) -> DataFrame:
    """Which stage table a job's session is built from."""
    generator = F.coalesce("generator", F.lit("default"))
    return jobs.withColumn(
        "result_stage",
        F.when(F.col("pipeline") == "multihop", F.lit("qa_multihop_generated"))
        .when(generator == "atomic", F.concat(generator, F.lit("/qa_generated")))
        .otherwise(F.concat(generator, F.lit("/qa_scored"))),
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """Events ``(job_id, created_at, event_id, stage)`` with the start of the following stage and the seconds to it."""
    following = next_in_group(events, ["job_id"], ["created_at", "event_id"], "created_at", "next_at")
    # an interval works alike for times with and without a zone
    gap = (F.col("next_at") - F.col("created_at")).cast("interval second").cast("decimal(20,6)")
    return following.withColumn("seconds", gap.cast("double"))


def qa_counts(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Items per job, zero for a job whose sessions are empty; counted per session before the join."""
    per_session = items.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    joined = sessions.select("session_id", "job_id").join(per_session, "session_id", "left")
    return joined.groupBy("job_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("qa_count"))


def as_versions(changed: DataFrame, items: DataFrame) -> DataFrame:
    """``changed`` rows as versions of ``items``, ready for ``upsert``.

    Fields that items have no column for (feedback, expansion notes) go into ``record_json``, and so do the present
    values of the hot columns, so that a later patch starts from them.
    """
    own = [c for c in changed.columns if c in items.columns]
    extra = [c for c in changed.columns if c not in items.columns]
    known = [c for c in HOT_FIELDS if c in changed.columns]
    fresh = F.to_json(F.struct(*dict.fromkeys([*known, *extra])))
    rest = [F.col(c) if c in own else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns if c != "record_json"]
    return changed.select(*rest, merge_json(F.col("record_json"), fresh).alias("record_json")).select(*items.columns)


def item_links(uploads: DataFrame, jobs: DataFrame, sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the session, job and upload that they belong to; an item, session or job without its owner drops out.

    The owners' ids are unique, so only the item side repeats a key. Each owner side is narrowed to its ids, measured and broadcast
    where it is small; beyond that it is written, and AQE splits the partition of an owner that holds most items.
    """
    owners = join_small(jobs.select("job_id", "upload_id"), uploads.select("upload_id"), ["upload_id"], "inner")
    owners = join_small(sessions.select("session_id", "job_id"), owners, ["job_id"], "inner")
    return join_small(items, owners, ["session_id"], "inner")


# --- paged views: top-k reports, so their limit is the feature ---------------------------------------


def job_page(jobs: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest jobs first; equal times are told apart by job id."""
    require(1 <= limit <= 500 and offset >= 0, "limit must be 1..500 and offset not negative")
    rows = jobs.filter(F.col("status") == status) if status else jobs
    return rows.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def item_page(items: DataFrame, session_id: str, limit: int = 500, offset: int = 0) -> DataFrame:
    """Undeleted items of one session in their order."""
    require(1 <= limit <= 5000 and offset >= 0, "limit must be 1..5000 and offset not negative")
    rows = items.filter((F.col("session_id") == session_id) & ~F.col("deleted"))
    return rows.orderBy("sort_index").offset(offset).limit(limit)


def record_page(records: DataFrame, order: list[str], limit: int = 500, offset: int = 0) -> DataFrame:
    """A slice of a record table in its order."""
    return records.orderBy(*order).offset(offset).limit(limit)


def search_questions(items: DataFrame, term: str) -> DataFrame:
    """Items whose question, answer or expanded question holds the term in any case."""
    wanted = F.lower(F.lit(term))
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in ("question", "answer", "expanded_question") if c in items.columns]
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.contains(text, wanted)
    return items.filter(hit)


# --- import of an older file layout -----------------------------------------------------------------

LEGACY_UPLOAD = "fileName string, size bigint, createdAt string"
LEGACY_JOB = (
    "job_id string, upload_id string, session_id string, source_file_name string, pipeline string, generator string, "
    "status string, stage string, params variant, qa_count bigint, error_message string, result_paths variant, "
    "created_at string, finished_at string"
)
LEGACY_SESSION = (
    "id string, jobId string, sourceFileName string, pipeline string, generator string, params variant, createdAt string, "
    "updatedAt string, items array<struct<id:string,record:string>>"
)
# What stands for an absent field.
LEGACY_FILE, LEGACY_PIPELINE = "document.md", "singlehop"


def _folder(path: Column, level: int) -> Column:
    """Name of a parent folder of a file."""
    return F.element_at(F.split(path, "/"), -level)


def read_legacy(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uploads, jobs and sessions of the older layout: one JSON file per object, several lines each.

    An upload is a folder with at least one file; its metadata may be missing. The listing reads no file's content.
    """
    reader, path = spark.read.option("multiLine", "true"), F.col("_metadata.file_path")
    listed = spark.read.format("binaryFile").load(f"{root}/uploads/*/*").select(_folder(F.col("path"), 2).alias("upload_id")).distinct()
    described = reader.schema(LEGACY_UPLOAD).json(f"{root}/uploads/*/meta.json").select(_folder(path, 2).alias("upload_id"), "*")
    uploads = listed.join(described, "upload_id", "left")
    jobs = reader.schema(LEGACY_JOB).json(f"{root}/jobs/*/meta.json")
    sessions = reader.schema(LEGACY_SESSION).json(f"{root}/sessions/*.json")
    stem = F.regexp_replace(_folder(path, 1), r"\.json\z", "")
    return uploads, jobs, sessions.withColumn("session_id", first_filled(F.col("id"), stem)).drop("id")


def free_form(value: Column) -> Column:
    """JSON text of a free-form field; what is absent, empty, zero or false becomes an empty object."""
    text = F.to_json(value)
    return F.when(text.isin("null", "{}", "[]", '""', "0", "false"), F.lit("{}")).otherwise(F.coalesce(text, F.lit("{}")))


def import_legacy(
    uploads: DataFrame, jobs: DataFrame, sessions: DataFrame, have: dict[str, DataFrame], now: Column | None = None
) -> dict[str, DataFrame]:
    """Rows to insert: present ids are left alone, missing uploads are made up, orphan sessions skipped.

    ``now`` stands for absent times (the current time if not given). A job that several sessions name belongs to the one with
    the greatest id; ``job_sessions`` lists that link for jobs that are there already, too. So every job is one row.
    """
    now = utc_now() if now is None else now
    name = lambda c: first_filled(F.col(c), F.lit(LEGACY_FILE))
    new_jobs = jobs.join(have["jobs"].select("job_id"), "job_id", "left_anti")
    named = uploads.select(
        "upload_id", name("fileName").alias("file_name"), F.coalesce("size", F.lit(0)).alias("size_bytes"), first_filled(F.col("createdAt"), now).alias("created_at")
    )
    implied = new_jobs.groupBy("upload_id").agg(
        F.min_by(name("source_file_name"), "job_id").alias("file_name"),
        F.lit(0).cast("bigint").alias("size_bytes"),
        F.min_by(first_filled(F.col("created_at"), now), "job_id").alias("created_at"),
    )
    missing = implied.join(named.select("upload_id"), "upload_id", "left_anti")
    new_uploads = named.unionByName(missing).join(have["uploads"].select("upload_id"), "upload_id", "left_anti")
    known_jobs = have["jobs"].select("job_id").unionByName(jobs.select("job_id")).distinct()
    created = first_filled(F.col("createdAt"), now)
    new_sessions = (
        sessions.filter(F.coalesce("jobId", F.lit("")) != "")
        .join(have["sessions"].select("session_id"), "session_id", "left_anti")
        .withColumnRenamed("jobId", "job_id")
        .join(known_jobs, "job_id", "left_semi")
        .select(
            "session_id", "job_id", name("sourceFileName").alias("source_file_name"),
            first_filled(F.col("pipeline"), F.lit(LEGACY_PIPELINE)).alias("pipeline"), "generator", free_form(F.col("params")).alias("params_json"),
            created.alias("created_at"), first_filled(F.col("updatedAt"), created).alias("updated_at"), "items",
        )
    )
    linked = new_sessions.groupBy("job_id").agg(F.max("session_id").alias("_session"))
    kept = [c for c in new_jobs.columns if c not in ("session_id", "params", "result_paths")]
    texts = [free_form(F.col(c)).alias(f"{c}_json") for c in ("params", "result_paths")]
    filed = new_jobs.select(*kept, "session_id", *texts).join(linked, "job_id", "left")
    filed = filed.withColumns({"session_id": F.coalesce("_session", "session_id"), "updated_at": first_filled(F.col("finished_at"), F.col("created_at"))})
    return {
        "uploads": new_uploads.withColumn("storage_path", F.concat(F.lit("uploads/"), "upload_id", F.lit("/doc.md"))),
        "jobs": filed.drop("_session"),
        "job_sessions": linked.withColumnRenamed("_session", "session_id"),
        "sessions": new_sessions.drop("items"),
        "items": new_sessions.select("session_id", "created_at", F.posexplode("items").alias("sort_index", "_i")).select(
            "session_id", "sort_index", "_i.*", "created_at"
        ),
    }

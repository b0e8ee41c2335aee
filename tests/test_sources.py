"""Files in, files out."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from qaspark.operators.export import AlpacaExport, MultiHopExport
from qaspark.operators.generation import ExpressionGenerator
from qaspark.operators.review import import_legacy, merge_json, read_legacy
from qaspark.plans import qa as flows
from qaspark.schemas import DIMENSIONS
from qaspark.sources import ingest
from qaspark.sources.jsonl import read_jsonl, write_jsonl
from qaspark.sources.markdown import read_markdown, read_uploads
from qaspark.sources.taxonomy import load_taxonomy


def test_markdown_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\r\n\r\nüber 中文\n", encoding="utf-8")
    (row,) = read_markdown(spark, str(tmp_path / "*.md")).collect()
    assert row.source_md.endswith("/a.md") and row.text == "# Title\r\n\r\nüber 中文\n"


def test_uploads(spark, tmp_path):
    (tmp_path / "good.MD").write_text("text")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "other.txt").write_text("text")
    (tmp_path / "bytes.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "long.md").write_text("x" * 50)
    rows = read_uploads(spark, str(tmp_path), limit=40).collect()
    assert [(r.path.rsplit("/", 1)[1], r.size_bytes, r.text) for r in rows] == [("good.MD", 4, "text")]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"a": "x\\u2028y", "b": 1}\n\n  \n[1]\n"s"\n{"a": null, "c": 2}\n', encoding="utf-8")
    rows = read_jsonl(spark, str(path), "a string, b int").collect()
    assert [(r.a, r.b) for r in rows if r.b] == [(f"x{chr(0x2028)}y", 1)] and len(rows) == 2
    path.write_text('{"a": 1}\n{"a": 1} x\n')
    with pytest.raises(Exception, match="malformed JSON line"):
        read_jsonl(spark, str(path), "a string").collect()


def test_jsonl_leaves_out_nulls_and_omitted(spark, tmp_path):
    rows = spark.createDataFrame([("é", None, "long")], "a string, b string, context string")
    write_jsonl(rows, str(tmp_path / "out"), omit=("context",))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert line == '{"a":"é"}'


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "sub" / "b.docx").write_text("x")
    (tmp_path / "sub" / "c.txt").write_text("x")
    (tmp_path / "sub" / ".png").write_text("x")
    rows = {r.source_path.rsplit("/", 1)[-1]: r for r in ingest.scan_directory(spark, str(tmp_path)).collect()}
    assert {k: r.kind for k, r in rows.items()} == {"a.PDF": "convert", "b.docx": "skipped"}
    assert len(rows["a.PDF"].sha256) == 64 and rows["b.docx"].sha256 is None


@pytest.mark.parametrize(
    "url, host, segment",
    [
        ("https://Ex.com/a?x=1", "Ex.com", "ex.com"), ("http://Ex.com:8080/p", "Ex.com:8080", "ex.com_8080"),
        ("http://[::1]:90/x", "[::1]:90", "[__1]_90"), ("http://[FE80::1]/", "[FE80::1]", "[fe80__1]"),
        ("ftp://user:pw@h/x", "user:pw@h", "user_pw@h"), ("http://h#f", "h", "h"),
    ],
)
def test_url_layout(spark, url, host, segment):
    row = ingest.url_layout(spark.createDataFrame([(url,)], "url string")).first()
    assert row.url_host == host and row.rel_path == f"urls/{segment}/{row.url_fingerprint}" and len(row.url_fingerprint) == 16


def test_relative_urls_keep_their_rows(spark):
    urls = spark.createDataFrame([("/a/b",), ("mailto:x",), ("http:///p",)], "url string")
    rows = ingest.url_layout(urls).collect()
    assert [(r.url_host, r.rel_path) for r in rows] == [("", None)] * 3
    fetched = urls.selectExpr("url", "'application/pdf' AS head_type", "'' AS get_type", "cast('%PDF' AS binary) AS body")
    nothing = spark.createDataFrame([], "url string, returncode int, has_output boolean, copy_error string, stderr string, duration_ms bigint, version string, backend string")
    done = ingest.url_manifest(fetched, nothing, "out").collect()
    assert [(r.status, r.error_code, r.output_md_path) for r in done] == [("failed", ingest.E_FAILED, "")] * 3


def test_a_url_fetched_twice_keeps_its_own_results(spark):
    """Each fetch gives one row with the result of its own file; a result that comes twice adds none."""
    fetches = [("http://h/x", "one", b"%PDF 1"), ("http://h/x", "two", b"%PDF 2"), ("http://h/y", "one", b"%PDF 1")]
    fetched = spark.createDataFrame([(*f, "application/pdf", "") for f in fetches], "url string, file string, body binary, head_type string, get_type string")
    results = [("http://h/x", "one", 0), ("http://h/x", "two", 1), ("http://h/y", "one", 0), ("http://h/y", "one", 0)]
    converted = spark.createDataFrame(results, "url string, file string, returncode int").selectExpr(
        "*", "true AS has_output", "cast(null AS string) AS copy_error", "'' AS stderr", "1L AS duration_ms", "'1' AS version", "'b' AS backend"
    )
    done = ingest.url_manifest(fetched, converted, "out", ("url", "file")).collect()
    assert sorted((r.source_path, r.sha256[:4], r.status) for r in done) == sorted(
        (u, hashlib.sha256(b).hexdigest()[:4], "failed" if f == "two" else "ok") for u, f, b in fetches
    )


def test_manifest_finds_texts_of_real_files(spark, tmp_path):
    """Plain paths of a manifest and the URIs of a reader name the same files, blanks and plus signs included."""
    from qaspark.sources.markdown import scan_manifest

    folder = tmp_path / "a b"
    folder.mkdir()
    for name in ("x y.md", "p+q.md"):
        (folder / name).write_text(name)
    manifest = spark.createDataFrame([(str(folder / n), "ok") for n in ("x y.md", "p+q.md", "gone.md")], "output_md_path string, status string")
    manifest = manifest.selectExpr("*", "'' AS source_path")
    found = scan_manifest(manifest, read_markdown(spark, str(folder))).collect()
    assert {(r.source_md, r.text) for r in found} == {(str(folder / n), n) for n in ("x y.md", "p+q.md")}


def test_scan_reads_accepted_files_only(spark, tmp_path):
    """A file that is ignored or too large is never opened, so its size cannot fail the scan."""
    (tmp_path / "big.txt").write_bytes(b"x" * 5000)
    (tmp_path / "big.md").write_bytes(b"x" * 5000)
    (tmp_path / "ok.MD").write_text("fine")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert [r.text for r in read_uploads(spark, str(tmp_path), limit=900).collect()] == ["fine"]
        assert [r.source_path for r in ingest.scan_directory(spark, str(tmp_path)).collect()] == ["a.pdf"]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_taxonomy_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"taxonomy": {"topic": "t", "level1_name": {"A": [{"level2_name": "B", "focus": "f", "prompt_hint": "h"}]}}}))
    t = load_taxonomy(path)
    assert t.topic == "t" and [c.level2_name for c in t.categories] == ["B"] and not t.is_complete()
    path.write_text("[]")
    with pytest.raises(ValueError):
        load_taxonomy(path)


def test_flow_writes_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([("d.md", "some words to ask about")], "source_md string, text string")
    generator = ExpressionGenerator(
        {
            "instructions": F.lit('["p"]'), "pairs": F.lit("Q: q\nA: a"), "expand": F.lit("?"), "think": F.lit('{"think": "t", "answer": "b"}'),
            **{d: F.lit("**Grading**: 4\n**Feedback**: ok") for d in DIMENSIONS},
        }
    )
    flows.markdown_qa(docs, generator, language="en", expand="detail", think=True, output_dir=str(tmp_path / "out"))
    stages = {p.name: [json.loads(line) for f in sorted(p.glob("*.json")) for line in f.read_text().splitlines()] for p in (tmp_path / "out").iterdir()}
    assert set(stages) == {f"{n}.jsonl" for n in ("chunks", "qa_generated", "qa_scored", "qa_expanded", "qa_with_think", "qa_export")}
    assert "context" in stages["qa_generated.jsonl"][0] and "chunk_text" not in stages["qa_scored.jsonl"][0]
    assert stages["qa_expanded.jsonl"][0]["expansion_status"] == "failed"
    assert stages["qa_export.jsonl"] == [
        {"instruction": AlpacaExport().instruction, "input": "q", "output": "b", "source_md": "d.md", "chunk_index": 0, "think": "t"}
    ]


def test_multihop_export_defaults(spark):
    rows = spark.createDataFrame([("d", 0, "q", "a", None, None, None)], "source_md string, chunk_index int, question string, answer string, "
                                 "reasoning_steps array<struct<step:string>>, supporting_facts array<string>, qa_type string")
    meta = MultiHopExport()(rows).first().metadata
    assert (meta.reasoning_steps, meta.supporting_facts, meta.type, meta.complexity) == ([], [], "", 0.0)


def test_merge_json(spark):
    def merged(a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(merge_json(F.col("a"), F.col("b")).alias("x")).first().x

    assert json.loads(merged('{"a": 1, "b": {"c": 2.50}, "d": "x\\"y"}', '{"b": null, "e": [1, true]}')) == {
        "a": 1, "d": 'x"y', "b": None, "e": [1, True],
    }
    assert merged("{}", None) == "{}"


def test_legacy_layout(spark, tmp_path):
    def put(path, value):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(value, indent=1))

    put("uploads/u1/meta.json", {"fileName": "a.md", "size": 3, "createdAt": "t0"})
    job = {"source_file_name": "b.md", "pipeline": "singlehop", "status": "succeeded", "created_at": "t1"}
    put("jobs/j1/meta.json", {"job_id": "j1", "upload_id": "u1", **job})
    put("jobs/j2/meta.json", {"job_id": "j2", "upload_id": "u2", **job})
    put("sessions/s1.json", {"jobId": "j1", "items": [{"id": "qa-0", "record": {"question": "q"}}]})
    put("jobs/j3/meta.json", {"job_id": "j3", "upload_id": "u3", **job, "params": {"n": [1, {"é": None}]}, "result_paths": {"export": "x"}})
    (tmp_path / "uploads/u3").mkdir()
    (tmp_path / "uploads/u3/doc.md").write_text("no metadata")
    for name in ("s4", "s5"):
        put(f"sessions/{name}.json", {"id": name, "jobId": "j3", "params": {"k": 1}, "createdAt": "t5", "items": []})
    put("sessions/s2.json", {"id": "s2", "jobId": "missing", "items": []})
    put("sessions/s3.json", {"id": "s3", "items": []})
    uploads, jobs, sessions = read_legacy(spark, str(tmp_path))
    none = lambda c: spark.createDataFrame([], f"{c} string")
    new = import_legacy(uploads, jobs, sessions, {"uploads": none("upload_id"), "jobs": none("job_id"), "sessions": none("session_id")})
    assert sorted((r.upload_id, r.file_name, r.size_bytes) for r in new["uploads"].collect()) == [("u1", "a.md", 3), ("u2", "b.md", 0), ("u3", "document.md", 0)]
    assert sorted((r.job_id, r.session_id) for r in new["jobs"].collect()) == [("j1", "s1"), ("j2", None), ("j3", "s5")]
    assert {r.job_id: (r.params_json, r.result_paths_json) for r in new["jobs"].collect()} == {"j1": ("{}", "{}"), "j2": ("{}", "{}"), "j3": ('{"n":[1,{"é":null}]}', '{"export":"x"}')}
    assert sorted((r.session_id, r.params_json, r.created_at, r.updated_at) for r in new["sessions"].collect())[1:] == [("s4", '{"k":1}', "t5", "t5"), ("s5", '{"k":1}', "t5", "t5")]
    assert [(r.session_id, r.id, json.loads(r.record)) for r in new["items"].collect()] == [("s1", "qa-0", {"question": "q"})]

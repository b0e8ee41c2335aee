"""Responses travel without texts, and equal prompts are asked once."""

import re

import pytest
from pyspark.sql import functions as F

from qaspark.operators.exchange import ROW_KEY, TextStore, row_key
from qaspark.operators.generation import CallableGenerator, ExpressionGenerator, RecordingGenerator, TableGenerator, prompt_hash
from qaspark.operators.generation import Ask

TEXTS = {"chunk_text": "chunk_text", "context": "chunk_text"}


def chunks(spark, n=40):
    rows = [(f"d{i % 7}", i, "same text" if i % 3 == 0 else f"text {i}") for i in range(n)]
    rows += [rows[4], (None, 1, "null source"), ("d0", None, None)]
    return spark.createDataFrame(rows, "source_md string, chunk_index int, chunk_text string")


def exchanged(df):
    """Columns that each exchange of the plan moves."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [m.group(1) for m in re.finditer(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]


def stored_for(rows, prompt, stage="s", system="sys"):
    return rows.select(F.lit(stage).alias("stage"), prompt_hash(prompt, system).alias("prompt_hash"), F.concat(F.lit("re: "), "chunk_text").alias("response"))


def test_no_text_crosses_a_response_join(spark):
    rows, prompt = chunks(spark), F.concat(F.lit("About "), "chunk_text")
    generator, marked = TableGenerator(stored_for(rows.filter("chunk_text IS NOT NULL"), prompt)).over(rows, TEXTS)
    wide = marked.withColumn("context", F.col("chunk_text"))
    asks = [Ask("s", prompt, "sys", "first"), Ask("s", F.concat(prompt, F.lit("?")), "sys", "second")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answered = generator.ask_all(wide, asks)
        again = generator.ask(answered.filter("first <> ''"), "s", F.concat(F.lit("About "), "context"), "sys")
        moved = exchanged(again)
        got = again.orderBy("source_md", "chunk_index").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved and not [m for m in moved if re.search(r"chunk_text|context", m)]
    assert len(got) == 42 and all(r["response"] == r["first"] == "re: " + r["chunk_text"] and r["context"] == r["chunk_text"] and r["second"] == "" for r in got)


@pytest.mark.parametrize("narrow", [True, False])
def test_rows_are_kept_whatever_they_hold(spark, narrow):
    rows, prompt = chunks(spark), F.concat(F.lit("About "), "chunk_text")
    plain = TableGenerator(stored_for(rows, prompt))
    generator, marked = plain.over(rows, TEXTS) if narrow else (plain, rows)
    got = generator.ask(marked, "s", prompt, "sys").drop(ROW_KEY)
    want = rows.withColumn("response", F.coalesce(F.concat(F.lit("re: "), "chunk_text"), F.lit("")))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_equal_prompts_are_asked_once(spark, tmp_path):
    folder = str(tmp_path)

    def call(prompts, system):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
            out.write(prompts[0])
        if prompts[0].endswith("7"):
            raise TimeoutError("late")
        return [p.upper() for p in prompts]

    rows = chunks(spark)
    generator, marked = CallableGenerator(call, threads=1).over(rows, TEXTS)
    got = generator.ask(marked, "s", F.concat(F.lit("About "), "chunk_text"), "sys").collect()
    sent = sorted(p.read_text() for p in tmp_path.iterdir())
    assert sent == sorted({"About " + r["chunk_text"] for r in rows.collect() if r["chunk_text"]})
    assert len(got) == rows.count()
    for r in got:
        if r["chunk_text"] is None:
            assert (r["response"], r["gen_status"]) == ("", "skipped")
        elif r["chunk_text"].endswith("7"):
            assert (r["response"], r["gen_status"], r["gen_error"]) == ("", "failed", "late")
        else:
            assert (r["response"], r["gen_status"]) == (("About " + r["chunk_text"]).upper(), "ok")
    both = generator.ask_all(marked, [Ask("a", F.col("chunk_text"), "", "x"), Ask("b", F.lit("one"), "", "y")])
    assert both.columns == [*marked.columns, "x", "y"] and both.filter("y = 'ONE'").count() == rows.count()


def test_recorded_responses_replay(spark):
    rows = chunks(spark)
    recorder = RecordingGenerator(ExpressionGenerator({"s": F.upper("chunk_text")}))
    first = recorder.ask(rows, "s", F.col("chunk_text"))
    replay = TableGenerator(recorder.recorded()).ask(rows, "s", F.col("chunk_text"))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, replay.collect()))
    assert recorder.recorded().count() == len({r["chunk_text"] for r in rows.collect()} - {None})


def test_texts_are_stored_once_for_each_key(spark):
    rows = chunks(spark)
    marked = rows.withColumn(ROW_KEY, row_key(rows))
    store = TextStore.of(marked, TEXTS)
    assert spark.table(store.table).columns == [ROW_KEY, "chunk_text"]
    assert spark.table(store.table).count() == rows.distinct().count()
    back = store.attach(store.detach(marked), ["chunk_text"])
    assert sorted(map(repr, back.select(*marked.columns).collect())) == sorted(map(repr, marked.collect()))


def test_multihop_texts_are_stored_once_for_each_chunk(spark, monkeypatch):
    """Contexts are built again from their chunk, with the same rows as a run that keeps them."""
    from checks.model import model
    from qaspark.plans import qa as flows

    text = ". ".join(f"Sentence number {i} tells of a thing" for i in range(40)) + "."
    documents = spark.createDataFrame([(f"d{i}", text if i else None) for i in range(4)] + [("d1", text)], "source_md string, text string")
    stores = []
    of = TextStore.of.__func__
    monkeypatch.setattr(TextStore, "of", classmethod(lambda cls, *args: stores.append(of(cls, *args)) or stores[-1]))
    recorder = RecordingGenerator(model("multihop"))
    stages = flows.markdown_multihop_qa(documents, recorder, chunk_words=300, language="en")
    recorded = recorder.recorded()
    for generator in (TableGenerator(recorded), TableGenerator(recorded, unique=True)):
        again = flows.markdown_multihop_qa(documents, generator, chunk_words=300, language="en")
        for name in ("chunks", "multihop_contexts", "qa_multihop_generated", "qa_multihop_export"):
            assert again[name].columns == stages[name].columns
            assert sorted(map(repr, again[name].collect())) == sorted(map(repr, stages[name].collect()))
    chunks, contexts = stages["chunks"], stages["multihop_contexts"]
    assert contexts.count() > 5 * chunks.count() and stages["qa_multihop_generated"].count() > 0
    assert {spark.table(s.table).count() for s in stores} == {chunks.distinct().count()}
    assert all("context" not in spark.table(s.table).columns for s in stores)


def test_recorded_calls_are_not_computed_again(spark):
    """A later call over a text store goes on from the written rows of the earlier one, and all are recorded."""
    rows = chunks(spark)
    recorder, marked = RecordingGenerator(ExpressionGenerator({"a": F.upper("chunk_text"), "b": F.reverse("first")})).over(rows, TEXTS)
    first = recorder.ask(marked, "a", F.col("chunk_text")).withColumnRenamed("response", "first")
    second = recorder.ask(first, "b", F.concat("chunk_text", F.col("first")))
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert "upper" not in plan and "reverse" not in plan
    want = rows.withColumn("first", F.upper("chunk_text")).withColumn("response", F.reverse("first"))
    want = want.fillna("", ["first", "response"])
    assert sorted(map(repr, second.drop(ROW_KEY).collect())) == sorted(map(repr, want.collect()))
    texts = len({r["chunk_text"] for r in rows.collect()} - {None})
    assert recorder.recorded().groupBy("stage").count().filter(f"count = {texts}").count() == 2


def test_rows_of_a_called_model_are_computed_once(spark):
    """The store of texts and the first call read rows that are written."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = chunks(spark)
    made = rows.withColumn("chunk_text", F.udf(counted, "string").asNondeterministic()("chunk_text"))
    generator, marked = CallableGenerator(lambda prompts, system: ["re: " + p for p in prompts]).over(made, TEXTS)
    got = generator.ask(marked, "s", F.col("chunk_text")).select("chunk_text", "response").collect()
    assert len(got) == rows.count() == seen.value
    assert all(r["response"] == ("re: " + r["chunk_text"] if r["chunk_text"] is not None else "") for r in got)


def multihop_documents(spark, n=3):
    text = ". ".join(f"Sentence number {i} tells of a thing" for i in range(40)) + "."
    return spark.createDataFrame([(f"d{i}", text) for i in range(n)] + [("d0", text)], "source_md string, text string")


def test_placed_responses_do_not_move(spark):
    """Only keys, hashes, places and questions are shuffled, in the steps that are written and in what is left to the reader."""
    from checks.model import model
    from qaspark.operators import generation
    from qaspark.plans import qa as flows

    moved, write = {}, generation.cut

    def seen(df, label, *rest):
        moved[label] = exchanged(df)
        return write(df, label, *rest)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(generation, "cut", seen)
            recorder = RecordingGenerator(model("multihop"))
            stages = flows.markdown_multihop_qa(multihop_documents(spark), recorder, chunk_words=300, language="en")
            replay = TableGenerator(recorder.recorded(), unique=True)
            again = flows.markdown_multihop_qa(multihop_documents(spark), replay, chunk_words=300, language="en")
            rows = again["qa_multihop_generated"].select("source_md", "question", "answer", "reasoning_steps", "rec_ord")
            moved["rows"] = exchanged(rows)
            got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [m for parts in moved.values() for m in parts if re.search(r"response|_stored|reasoning_steps|_pairs|premise|chunk_text", m)]
    want = stages["qa_multihop_generated"].select("source_md", "question", "answer", "reasoning_steps", "rec_ord").collect()
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_least_response_of_a_prompt_is_recorded_with_its_place(spark):
    rows = spark.createDataFrame(
        [("p1", "b"), ("p1", "a"), ("p1", "c"), ("p2", "x"), ("p2", "x"), ("p3", ""), (None, "n")], "p string, r string"
    ).repartition(3)
    recorder = RecordingGenerator(ExpressionGenerator({"s": F.col("r")}))
    for stage in ("s", "s"):
        recorder.ask_bare(rows, stage, F.col("p"), "sys", lambda answered: answered)
    recorded = recorder.recorded()
    want = rows.filter("p IS NOT NULL").groupBy(prompt_hash(F.col("p"), "sys").alias("h")).agg(F.min("r"))
    assert sorted(map(tuple, recorded.select("prompt_hash", "response").collect())) == sorted(map(tuple, want.collect()))
    assert recorded.select("_place").distinct().count() == recorded.count() == 3


def test_rows_without_a_response_stay(spark):
    """A prompt that has no stored response, or none at all, has nothing read; the others meet theirs."""
    rows = chunks(spark)
    recorder = RecordingGenerator(ExpressionGenerator({"s": F.concat(F.lit("re: "), "chunk_text")}))
    read = lambda answered: answered.withColumn("said", F.col("response"))
    recorder.ask_bare(rows.filter("chunk_text <> 'text 4'"), "s", F.col("chunk_text"), "sys", read)
    generator, marked = TableGenerator(recorder.recorded(), unique=True).over(rows, {"chunk_text": "chunk_text"}, (), None)
    assert sorted(map(repr, marked.drop(ROW_KEY).select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    bare = generator.ask_bare(marked, "s", F.col("chunk_text"), "sys", read)
    got = bare.attach(bare.rows).select("source_md", "chunk_index", "chunk_text", "said").collect()
    said = F.when(F.col("chunk_text") != "text 4", F.concat(F.lit("re: "), "chunk_text"))
    assert sorted(map(repr, got)) == sorted(map(repr, rows.withColumn("said", said).collect()))


def test_shuffle_files_of_a_written_table_go(spark):
    import time

    from qaspark.session import SHUFFLE_CLEANUP, cut_in_buckets

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {re.sub(r"^(shuffle_\d+)_.*", r"\1", f) for f in re.findall(r"shuffle_\d+_\S+?\.data", disk.getAllFiles().mkString(" "))}
    before = names()
    written = cut_in_buckets(spark.range(1000).withColumn("k", F.col("id") % 7), "numbers", "k", ["k", "id"])
    until = time.time() + 10
    while names() - before and time.time() < until:
        time.sleep(0.2)
    assert not names() - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None and written.count() == 1000

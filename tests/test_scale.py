"""Hot keys, block borders and the shape of plans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import REGISTRY
from checks.registry import documents
from qaspark.operators import base
from qaspark.operators.base import first_per_group, fits_broadcast, join_small
from qaspark.operators.chunking import SemanticChunks, WordChunks
from qaspark.operators.contexts import MultiHopContexts
from qaspark.operators.generation import TableGenerator, prompt_hash
from qaspark.operators.multihop import FirstByQuestion
from qaspark.operators.ordering import dense_index, dense_index_in_group, next_in_group, sorted_blocks
from qaspark.sources.tables import spread
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows: two thirds under one key, many small keys, one key alone."""
    key = F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") == 5, F.lit("alone")).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(3000).select(key.alias("k"), (F.col("id") * 7919 % 3001).alias("o"), F.col("id").alias("v"))


def test_blocks_split_a_hot_key(skewed):
    blocks = sorted_blocks(skewed, ["k"], ["o"])
    assert blocks.filter("k = 'hot'").select("_blk").distinct().count() > 2
    assert blocks.groupBy("_blk").count().agg(F.max("count")).first()[0] < 1500


def test_dense_numbers_equal_a_window(skewed):
    w = Window.partitionBy("k").orderBy("o")
    want = {r.v: (r.g, r.n) for r in skewed.select("v", (F.row_number().over(w) - 1).alias("g"), F.lead("v").over(w).alias("n")).collect()}
    grouped = {r.v: r.idx for r in dense_index_in_group(skewed, ["k"], ["o"]).collect()}
    following = {r.v: r.nxt for r in next_in_group(skewed, ["k"], ["o"], "v", "nxt").collect()}
    assert {v: (grouped[v], following[v]) for v in want} == want and len(grouped) == len(following) == 3000
    numbered = dense_index(skewed, ["o"]).orderBy("idx").collect()
    assert [r.idx for r in numbered] == list(range(3000)) and [r.o for r in numbered] == sorted(r.o for r in numbered)


def test_dense_numbers_with_null_keys_and_few_rows(spark):
    rows = spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "k string, o int")
    assert sorted((r.k or "", r.o, r.idx) for r in dense_index_in_group(rows, ["k"], ["o"]).collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]
    assert dense_index(rows.limit(0), ["o"]).count() == 0


def test_first_rows_of_a_hot_group(spark, skewed):
    for n in (1, 3, 1500):
        want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o"))).filter(F.col("rn") <= n).select("k", "o", "v")
        got = first_per_group(skewed, ["k"], ["o"], n).select("k", "o", "v")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert "WindowGroupLimit" in plan(first_per_group(skewed, ["k"], ["o"], 3))
    # beyond the limit of that rewrite the hot group is cut under salts first
    assert plan(first_per_group(skewed, ["k"], ["o"], 1500)).count("row_number()") >= 2


def test_broadcast_only_when_counted_small(spark, skewed, monkeypatch):
    side = skewed.select("k").distinct()
    assert fits_broadcast(side)
    assert "Broadcast" in plan(join_small(skewed, side, ["k"], "left_semi"))
    monkeypatch.setattr(base, "BROADCAST_ROWS", 3)
    assert not fits_broadcast(side)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(join_small(skewed, side, ["k"], "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_prompt_is_split_by_aqe(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        prompt = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        noise = F.concat(*[F.sha2(F.concat("id", F.lit(k)), 512) for k in "abc"])
        rows = spark.range(0, 120000, 1, 8).select(prompt.alias("t"), noise.alias("pad"))
        stored = rows.select(F.lit("s").alias("stage"), prompt_hash(F.col("t")).alias("prompt_hash"), F.col("t").alias("response"))
        asked = TableGenerator(stored).ask(rows, "s", F.col("t")).select("response", "pad")
        asked.collect()
        assert "SortMergeJoin(skew=true)" in plan(asked)
        assert asked.filter("response = 'hot'").count() == 40000 and asked.count() == 120000
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_chunking_needs_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("source").alias("source_md"), "text")
    for operator in (WordChunks(), SemanticChunks()):
        chunks = operator(docs)
        text = plan(MultiHopContexts("en")(chunks))
        assert "Exchange" not in text and "Python" not in text and "Window" not in text
        assert "ReadSchema: struct<text:string,source:string>" in text


def test_only_used_columns_are_read(spark):
    text = plan(REGISTRY["qa_counts"].run(spark, SMALL))
    for part in text.split("ReadSchema")[1:]:
        assert "props" not in part.split("\n")[0]
    narrow = plan(WordChunks()(documents(spark, SMALL)).select("source_md", "chunk_index"))
    assert "lang" not in narrow and "n_chars" not in narrow


def test_first_by_question_limits_before_the_shuffle(spark):
    source = F.concat(F.lit("s"), F.col("id") % 2)
    rows = spark.range(10).select(
        source.alias("source_md"), F.lit(0).alias("chunk_index"), F.array("id").alias("rec_ord"), source.alias("question")
    )
    text = plan(FirstByQuestion()(rows))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join(spark, name):
    text = plan(REGISTRY[name].run(spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_spread_only_small_scans(spark, tmp_path):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(4000).repartition(20).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))
    try:
        many = spark.read.parquet(str(tmp_path / "t"))
        assert "Exchange" not in plan(spread(many))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_operators_run_on_streams(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("d", "one two three four five")], "source_md string, text string").write.parquet(source)
    stream = spark.readStream.schema("source_md string, text string").parquet(source)
    query = WordChunks(2)(stream).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(sink)
    query.awaitTermination(120)
    assert sorted(r.chunk_text for r in spark.read.parquet(sink).collect()) == ["five", "one two", "three four"]


def test_one_group_over_hundreds_of_blocks(spark):
    """A group that fills every block is numbered by one running sum over the blocks."""
    from qaspark.operators.ordering import dense_index_in_group

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "520")
    try:
        rows = spark.range(6000).select(F.when(F.col("id") < 20, "a").when(F.col("id") < 5980, "hot").otherwise("z").alias("g"), "id")
        found = dense_index_in_group(rows, ["g"], ["id"], "idx").groupBy("g").agg(
            F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("idx").alias("n"), F.max(F.abs(F.col("id") - F.col("idx"))).alias("shift")
        )
        assert {tuple(r) for r in found.collect()} == {("a", 0, 19, 20, 0), ("hot", 0, 5959, 5960, 20), ("z", 0, 19, 20, 5980)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_folds_grow_in_proportion(spark):
    """Twice the input takes about twice the time, far from the fourfold of a copying fold."""
    import time

    from qaspark.operators.chunking import pack
    from qaspark.operators.multihop import braced_objects

    unit = F.struct(F.lit("word").alias("text"), F.lit(4).alias("size"), F.lit(-1).alias("run"), F.lit(2).alias("joint"), F.lit("\n\n").alias("sep"))

    def seconds(n, column):
        started = time.time()
        spark.range(1).select(F.size(column(n)).alias("n")).collect()
        return time.time() - started

    for column, expected in (
        (lambda n: braced_objects(F.repeat(F.lit("{a{b}c} "), F.lit(n))), lambda n: n),
        (lambda n: pack(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: unit), 10), lambda n: -(-n // 2)),
    ):
        assert spark.range(1).select(F.size(column(1001)).alias("n")).first().n == expected(1001)
        seconds(20_000, column)
        assert seconds(80_000, column) < 3 * seconds(40_000, column) + 2


def test_large_limits_meet_in_a_tree_of_salts(spark, skewed):
    """No window sees more than FAN times n rows of a group: the levels are planned, whatever the number of partitions is."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        cut = first_per_group(skewed, ["k"], ["o"], 1200)
        assert plan(cut).count("row_number()") >= 3 and "_salt" not in cut.columns
        want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o"))).filter("rn <= 1200").drop("rn")
        assert cut.exceptAll(want).count() == want.exceptAll(cut).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_groups_are_numbered_alike_with_and_without_a_broadcast(spark, skewed, monkeypatch):
    few = dense_index_in_group(skewed, ["k"], ["o"])
    assert "row_number()" not in plan(few) and "BroadcastHashJoin" in plan(few)
    monkeypatch.setattr("qaspark.operators.ordering.fits_broadcast", lambda df: False)
    many = dense_index_in_group(skewed, ["k"], ["o"])
    assert "row_number()" in plan(many)
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("fp", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    words = [f"w{i % 977}x{i % 13}" for i in range(60_000)]
    long = " ".join(words)
    texts = [None, "", " \t\n", "one", "one two", "one  two ", "One Two", long, long + " end", "a b c d e f g", None, "", "é ü ñ 日本 🙂", "one"]
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 0.5) for i, t in enumerate(texts)]
    rows += [(None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[5], rows[5], rows[0], (2**60 + 1, "big id", "en", "s", 6, "", "", 0.0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)

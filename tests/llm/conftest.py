import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.StringType()),
    T.StructField("shard", T.StringType()),
])


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, repeated rows and ids, and clashing names."""
    long = "word other third " * 40_000
    rows = [
        (1, None, None, None, None, "x", None),
        (2, "", "en", "a", 0, None, "y"),
        (3, long, "en", "a", 1, "x", "y"),
        (3, long, "en", "a", 1, "x", "y"),
        (None, "no id here at all", "de", "b", 1, None, None),
        (4, "the same words stand here again", "en", None, 1, None, None),
        (5, "the same words stand here again", "en", "b", 1, None, None),
        (5, "another text of this id", "fr", "b", 1, None, None),
        (6, "\x00 \u2581 \U0001f600 漢字 é\t\n1234 %%%", "fr", "b", 1, None, None),
        (7, "   \n\t ", "fr", "c", 1, None, None),
        (8, "a" * 5000, "de", "c", 1, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("print", T.StringType()),
     T.StructField("word", T.StringType()), T.StructField("doc", T.StringType())]
)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of given (doc_id, text) rows, with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(d, t, "x", "y", None) for d, t in rows], SCHEMA).repartition(3)

    return make


LONG = " ".join(f"word{i % 977} t{i}" for i in range(30_000))

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "one  two\tthree\n"), (7, "one two three "),
    (8, "Don't STOP <|endoftext|> now<|startoftext|>x é é   ,,,!!"), (9, "a\x1cb  \n\n c d \r\n e"),
    (10, "naïve 日本語 テスト 12345 ©®"), (11, LONG), (12, LONG), (13, "x" * 5000), (14, "  lead and trail  "),
    (15, "́ combining first"), (16, "don't we'll  they'RE 's"), (17, "\U0001f600 \U0001f468‍\U0001f469"),
]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)

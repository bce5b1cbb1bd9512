import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text) pairs, with further columns, some of clashing names."""

    def make(rows, source="s"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(source)).withColumn("n_chars", F.length("text").cast("long"))
        return df.withColumn("size", F.lit("x")).withColumn("start", F.lit(1)).withColumn("label", F.lit(None).cast("int"))

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "tie tie"), (6, "tie tie"), (7, "word " * 4000), (7, "word " * 4000), (None, "no id here at all"), (9, "é日本😀 " * 30)]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def empty(documents):
    return documents([])

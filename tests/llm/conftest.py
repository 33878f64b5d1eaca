import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()), T.StructField("n", T.LongType())]
)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)

    return make

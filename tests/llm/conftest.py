import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from a list of (doc_id, text)."""
    return lambda rows: spark.createDataFrame(rows, DOC)

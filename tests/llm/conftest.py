import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) or (doc_id, text, source) rows as a table like ``documents``."""

    def make(rows, **extra):
        full = [
            (row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1] or "")) for row in rows
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given documents as a list of (doc_id, text)."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(row["doc_id"], row["text"]) for row in rows]

import pytest
from pyspark.sql import types as T

#: More columns than the operators need, under names that they use themselves.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("rid", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("h", T.StringType()), T.StructField("row", T.StringType()),
])


@pytest.fixture
def make(spark):
    """rows (doc_id, text[, lang]) -> documents with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def docs_pdf():
    import pandas as pd

    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table of (doc_id, text) or (doc_id, text, source) rows."""
    def build(rows, **extra):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df
    return build


@pytest.fixture(scope="session")
def small():
    """The smallest given documents, as a pandas table."""
    import pandas as pd

    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")

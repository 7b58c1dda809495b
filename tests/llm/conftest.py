"""Brute-force helpers and small tables for the training-data operators."""

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("score", T.StringType()), T.StructField("n_words", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """A documents table with columns whose names clash with results, in ``parts`` partitions."""
    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOC_SCHEMA).repartition(parts)
    return make


def collected(df, *columns):
    """Rows as tuples, sorted, nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()),
                  key=lambda r: tuple((x is not None, x) for x in r))

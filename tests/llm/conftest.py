import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that clash with columns the operators make
        T.StructField("size", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with clashing extra columns from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "k", "s", "p", "d", "b")
            for r in rows
        ]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.01"

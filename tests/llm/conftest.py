import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or from texts."""

    def make(rows, langs=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, langs[k] if langs else "en", "s", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, a repeated id, a column whose name clashes."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "   \n"), (4, "One two."), (4, "One two."), (5, "word " * 30_000), (None, "no id here, but text that is long enough to count for something"), (6, "é" * 50), (7, "a" * 3000), (7, "other text under one id")]
    return make_docs(rows).withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("score", F.lit("x"))

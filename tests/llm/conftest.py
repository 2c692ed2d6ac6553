import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with the usual columns out of (doc_id, text) pairs, over a few partitions."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, gram string, k string", parts=3):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


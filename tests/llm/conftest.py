import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __id string, fp int"


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes a documents table (with columns whose names clash) from (doc_id, text) pairs."""

    def make(rows, lang=None):
        return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), "x", 1) for i, t in rows], DOCS)

    return make

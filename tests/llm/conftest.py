import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from texts, with ids from 0 and an extra column of a clashing name."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make

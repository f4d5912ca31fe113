import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", -1, -1, None) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, size long, row string")

    return make

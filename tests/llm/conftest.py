import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with an extra column of a clashing name."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string")

    return make

import pytest


@pytest.fixture
def table(spark):
    """Documents with columns whose names the operators also use."""

    def make(rows, id_type="long"):
        rows = [(i, t, "x", 1, "y", 2) for i, t in rows]
        return spark.createDataFrame(rows, f"doc_id {id_type}, text string, id string, n long, spans string, component int")

    return make

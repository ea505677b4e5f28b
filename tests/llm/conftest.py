import pytest

from tidewave.llm._shared import Scratch


@pytest.fixture
def documents(spark):
    def make(texts, extra=None):
        rows = [(i, t) if isinstance(t, (str, type(None))) else t for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "tests")

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text), with columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1.5, 7) for i, t in rows],
                                     "doc_id long, text string, source string, score double, spans int")
    return make

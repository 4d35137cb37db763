import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sourceloom.session import build_session

    session = build_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    def make(texts: dict):
        return spark.createDataFrame(list(texts.items()), "path string, content string")

    return make

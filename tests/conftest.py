import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lineglass.session import local_session

    session = local_session(
        4, 4, **{"spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


FILES = "project string, path string, content string"


@pytest.fixture
def files(spark):
    return lambda rows: spark.createDataFrame(rows, FILES)

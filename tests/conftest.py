import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from queuemill.runtime import build_session
    session = build_session("tests", 8, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
                                           "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()

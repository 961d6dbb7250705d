import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from scenelake.session import clean_up, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "scenelake-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    clean_up(session)
    session.stop()

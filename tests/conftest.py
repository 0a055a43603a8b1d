import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from askloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, "askloom-tests", **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


def rows(df):
    """Rows of a DataFrame as sorted tuples."""
    return sorted(tuple(r) for r in df.collect())

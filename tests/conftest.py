import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from graphloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "graphloom-tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Build a `files` DataFrame from {path: text}."""
    from graphloom.schemas import FILES

    def make(tree: dict[str, str]):
        rows = []
        for path, raw in tree.items():
            folder, _, name = path.rpartition("/")
            stem, dot, ext = name.rpartition(".")
            rows.append(("repo", path, folder, name, stem if dot else name, "." + ext if dot and stem else "", "", len(raw), raw))
        return spark.createDataFrame(rows, FILES)

    return make

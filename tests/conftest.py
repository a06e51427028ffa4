import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeq.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "codeq-tests")


@pytest.fixture(scope="session")
def make_files(spark):
    """A files table from {file_id: (filename, content)} or {file_id: (filename, content, review)}."""
    from codeq.schemas import FILES

    def make(entries):
        rows = [(i, e[2] if len(e) > 2 else "r", e[0], e[1]) for i, e in entries.items()]
        return spark.createDataFrame(rows, FILES)
    return make

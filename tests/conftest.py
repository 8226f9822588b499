import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labelloom.session import local_session  # noqa: E402

LABELLED = "row_id bigint, prompt string, y int, source string, subtype string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def labelled(spark):
    """Rows (prompt, y, source, subtype) as a table with ids in order."""

    def build(rows):
        return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], LABELLED)

    return build

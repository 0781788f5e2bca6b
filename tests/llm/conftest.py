import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from fixtures import MESSY, SCHEMA, rows_of  # noqa: E402


@pytest.fixture()
def messy(spark):
    return spark.createDataFrame(rows_of(MESSY), SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def make(spark):
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)

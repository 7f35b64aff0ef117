import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from odd_tables import frame, odd_rows  # noqa: E402


@pytest.fixture
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture
def empty(spark):
    return frame(spark, []).where("doc_id is null and 1 = 0")


@pytest.fixture
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (1, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

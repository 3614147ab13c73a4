import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_documents import odd_rows  # noqa: E402

COLUMNS = "doc_id long, text string, source string, `a.b` string, part int, key string, n int, size string, mix int, keep_id int, suspect int"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, None, i, None, i % 3, "s", None, 4, 1) for i, r in enumerate(odd_rows())]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)

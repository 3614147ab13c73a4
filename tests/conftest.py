import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelweave.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="tests-") as folder:
        session = build_session("local[8]", 8, "tests", **{
            "spark.driver.memory": "8g", "spark.checkpoint.dir": folder, "spark.panelweave.textTasks": "8"})
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL

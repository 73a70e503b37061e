import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from marlstone.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"

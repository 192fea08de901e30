import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session

    shared = tempfile.mkdtemp(prefix="tessera-test-")
    s = build_session("tests", master="local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": f"{shared}/shared", "spark.local.dir": f"{shared}/local", "spark.sql.warehouse.dir": f"{shared}/warehouse",
        "spark.driver.memory": "3g",
    })
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

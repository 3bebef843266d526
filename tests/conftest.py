import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import get_session

    session = get_session("tests", "8", **{"spark.driver.memory": "6g", "spark.sql.warehouse.dir": "/tmp/lodestone-warehouse", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.01"

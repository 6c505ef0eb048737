import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lorekeep.session import session

    place = tmp_path_factory.mktemp("spark")
    made = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(place / "shared"), "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.driver.extraJavaOptions": f"-Dderby.system.home={place}",
    })
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()

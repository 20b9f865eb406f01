import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clickwarden.session import build_session  # noqa: E402


# Quicker than RocksDB where state is tiny; test_streaming.py also runs a query on RocksDB.
SMALL_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("clickwarden-tests", "local[8]", {
        "spark.sql.shuffle.partitions": "2",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        "spark.sql.streaming.stateStore.providerClass": SMALL_STATE,
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Applied only where the caller and spark-submit have left a setting open.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Window state of many ips does not fit the executor heap; RocksDB keeps it off-heap and on
    # disk, and the changelog makes each micro-batch upload what changed, not the whole store.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "clickwarden", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings, where neither `settings` nor spark-submit gives others.

    A session that is already running keeps its own; only `settings` are set on it.
    """
    running = SparkSession.getActiveSession() is not None
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    if not running:
        given = session.sparkContext.getConf()
        for key, value in SESSION_SETTINGS.items():
            if not given.contains(key):
                session.conf.set(key, value)
    return session


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below `spark.checkpoint.dir`, which every executor can reach.

    Where the setting is open, a local session gets a temporary folder; a cluster session is
    refused, because a folder of the driver's machine would not be there for the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clickwarden-")
    return f"{base.rstrip('/')}/clickwarden-{uuid.uuid4().hex}"

"""Session helpers for tests and the benchmark; the library itself never
creates or configures a session (every operator takes a DataFrame)."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tablewash", extra_conf: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g"))
    for k, v in {**_DEFAULTS, **(extra_conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_local_folder: tempfile.TemporaryDirectory | None = None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The folder the session names is used as it is. Only a ``local[...]``
    session without one (tests, the benchmark) gets a private temporary
    folder; on a cluster a machine-local folder would be wrong, so an unset
    setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    global _local_folder
    if _local_folder is None:  # one for the process, removed when it ends
        _local_folder = tempfile.TemporaryDirectory(prefix="tablewash-ckpt-", ignore_cleanup_errors=True)
    sc.setCheckpointDir(_local_folder.name)
    return sc.getCheckpointDir()


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A folder for written intermediate tables, under the shared checkpoint
    folder so that every executor sees it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"

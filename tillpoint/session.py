"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  AQE re-plans joins from
# runtime sizes (broadcast only when the measured side is small), splits
# skewed join partitions, and coalesces small shuffle partitions.
_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# A scan task reads so much.  Compressed invoice lines take some 20 bytes in a
# file and ten times that in a task that groups them, so Spark's default of
# 128 MB would be more than a task's share of an executor's memory.
_SPLIT = "spark.sql.files.maxPartitionBytes"
_SPLIT_BYTES, _SPLIT_DEFAULT = "32m", "134217728b"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tillpoint") -> SparkSession:
    """Return a session configured for this package.

    ``master`` is only applied when given (tests and the local bench); on a
    cluster the launcher decides.  Shuffle partitions default to
    ``4 x cores`` locally and are left to the cluster config otherwise.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("TILLPOINT_DRIVER_MEMORY", "12g"))
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in _SQL_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_sql_conf(spark: SparkSession) -> None:
    """Apply the package's SQL settings to a session created elsewhere.  A split
    size that was configured stays."""
    for k, v in _SQL_CONF.items():
        spark.conf.set(k, v)
    if spark.conf.get(_SPLIT) == _SPLIT_DEFAULT:
        spark.conf.set(_SPLIT, _SPLIT_BYTES)


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session with a local master (tests, bench) may do without one; it
    gets a private temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder on the cluster")
    if sc.applicationId not in _SCRATCH:
        _SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="tillpoint-ckpt-")
    return _SCRATCH[sc.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable ``DataFrame.checkpoint()`` has a directory, the one
    of ``shared_folder`` unless the session has one already."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()

"""SparkSession construction with the settings every job here relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results, not only speed: the report's date filter takes
# the *date* of a zone-aware timestamp, so the session zone decides the day.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Scale settings: adaptive execution re-plans joins from runtime sizes (a
# dimension becomes a broadcast only when its measured size is under the
# threshold), splits skewed shuffle partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "railyard") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**RESULT_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k, v in RESULT_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE_DIRS: dict[int, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    ``spark.checkpoint.dir`` is a core setting read when the context starts
    (it cannot be changed from a session).  Only when it is absent (local
    tests) is a private folder created and registered with
    ``SparkContext.setCheckpointDir``, so that ``checkpoint()`` and the
    written intermediate tables still have a home.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = _PRIVATE_DIRS.get(id(sc)) or tempfile.mkdtemp(prefix="railyard-ckpt-")
        _PRIVATE_DIRS[id(sc)] = d
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)

"""Spark session and shared-storage helpers.

Everything in the library takes an existing ``SparkSession``; this module only
builds one for tests / benchmarks (it is not meant for a cluster, whose own
settings win) and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str] = {}  # application id -> scratch folder, local masters only


def build_session(master: str | None = None, app: str = "pixelmill",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session with the settings the library assumes (AQE on, UI off,
    UTC clock, Arrow transfer on, few shuffle partitions). For tests and the
    bench only: a cluster sizes its own partitions."""
    master = master or os.environ.get("PIXELMILL_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PIXELMILL_DRIVER_MEM", "16g"))
        .config("spark.sql.shuffle.partitions",
                str(shuffle_partitions or os.environ.get("PIXELMILL_SHUFFLE_PARTITIONS", "8")))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    The setting is read from the session and never changed. Where it is unset,
    a local master (tests) gets one scratch folder per application; any other
    master is an error, since a driver-local folder is not visible to its
    executors."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        if sc.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="pixelmill-ckpt-")
        path = _LOCAL_FOLDERS[sc.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared folder for one job's output."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

"""Session construction and the shared scratch location.

The builder sets what every job in this package relies on: ANSI mode
(bad casts raise), UTC session time, adaptive query execution (runtime
coalescing and skew-join splitting) and no web UI.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings applied by ``build_session``; a cluster submit may override any of them.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "lakeprep",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return a session configured for this package.

    ``master`` is only set when given (a cluster launcher sets it itself).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``. Only a local-mode session
    without that setting (tests, the laptop) gets a fresh private folder,
    which is then registered as the checkpoint dir too. A cluster session
    without the setting is an error: a machine-local folder is not visible
    to other executors and does not survive their loss.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS, S3, ...) before running lakeprep jobs on a cluster")
    path = tempfile.mkdtemp(prefix="lakeprep-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused location under ``scratch_root`` (never reused)."""
    root = scratch_root(spark)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python can open a local-mode path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def cut_lineage(df):
    """Reliable checkpoint of ``df`` into the shared checkpoint folder.

    Later jobs (and retries after an executor loss) start from the written
    files instead of replaying the whole chain. Never a local checkpoint:
    those live on executor disks and vanish with the executor.
    """
    scratch_root(df.sparkSession)          # make sure a checkpoint dir is known
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint(eager=True)

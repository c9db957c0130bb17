"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster job should carry; tests and bench use the same ones so
# measured plans match what runs at scale.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state on the executors' disks, not in their heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "revlens",
                  extra: dict | None = None) -> SparkSession:
    """Local or cluster session with AQE on.

    ``master=None`` leaves the master, and the shuffle partition count unless
    one is given, to spark-submit and the cluster's defaults; AQE then
    coalesces small partitions to the advisory size rather than keeping
    parallelism, and splits skewed ones. Local sessions (tests, bench) pass a
    partition count sized for their cores.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    elif master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = "8"
    if not master:
        conf["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set (a shared file system): executors do
    not see each other's local folders, so a session without it is refused.
    Only a local session, as in tests, gets a private temporary folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError(f"spark.checkpoint.dir is not set and {sc.master} is not a local master: "
                                   "name a folder that all executors share")
            d = tempfile.mkdtemp(prefix="revlens-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under this application's part of the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/revlens/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete every scratch table this application wrote; call it when no
    result is read any more, at the end of a job. True if there was any."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, on whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def local_fs_path(path: str) -> str:
    """``file:/x``, ``file:///x`` or ``/x`` → ``/x`` (for Python's own file calls)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return path


def ensure_dir(path: str) -> None:
    if is_local_path(path):
        os.makedirs(local_fs_path(path), exist_ok=True)

"""Spark session and scratch-location helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "chatsift") -> SparkSession:
    """A local session for tests and the benchmark (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CHATSIFT_DRIVER_MEMORY", _default_driver_memory()))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _default_driver_memory() -> str:
    """About 60% of physical memory, capped at 16 GB (local mode: the driver runs the tasks)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster's shared location). When it is unset, a local
    master gets a fresh temporary folder; any other master is an error, since executors do not
    share a machine's temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="chatsift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/chatsift-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables (default: all that this process made) once nothing reads them any
    more; returns how many were deleted."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for path in list(_SCRATCH if paths is None else paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        done += bool(p.getFileSystem(conf).delete(p, True))
        if path in _SCRATCH:
            _SCRATCH.remove(path)
    return done


def materialize(df, name: str):
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads the table instead of
    recomputing the plan), but computes the plan once: a reliable ``checkpoint()`` of an uncached
    plan runs it a second time to write the checkpoint files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


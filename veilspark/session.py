"""Session helpers: building a local session for tests/bench and locating the
shared scratch folder (``spark.checkpoint.dir``) used to cut lineage and land
intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "veilspark") -> SparkSession:
    """Local session for tests and the bench. On a cluster the session is
    created by the launcher and this function is not used."""
    master = master or os.environ.get("VEILSPARK_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VEILSPARK_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, which the cluster names in
    ``spark.checkpoint.dir``. Only a local session (tests, the bench) may leave
    it unset: it gets a private folder that is removed when Python exits. On a
    cluster an unset folder is an error, since driver and executors have
    different disks."""
    d = spark.conf.get(CHECKPOINT_KEY, None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="veilspark-ckpt-", dir=os.environ.get("VEILSPARK_SCRATCH", "/tmp"))
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the application's folder for a landed table."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession) -> bool:
    """Remove all tables that this application has landed. Call it when their
    results have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers: a local session for tests/bench and shared-folder lookup."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests and bench.  On a cluster the caller builds its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by whoever runs the job (it has to be
    visible to every executor).  Only a local-mode session without the setting
    gets a fresh folder of its own, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.conf.get("spark.app.id", "") or "local"
        path = _LOCAL_DIRS.get(app) or tempfile.mkdtemp(prefix="runledger-ckpt-")
        _LOCAL_DIRS[app] = path
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - a static conf in some deployments
            pass
    try:  # classic sessions: also the RDD checkpoint folder used by checkpoint()
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    if "://" not in base:
        os.makedirs(base, exist_ok=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

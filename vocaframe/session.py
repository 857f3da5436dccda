"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "vocaframe", driver_memory: str | None = None) -> SparkSession:
    """A session with the settings this library is tuned for.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``spark.sql.shuffle.partitions`` to the data (AQE coalesces small ones)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # audio batches carry whole files; keep Arrow batches small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:  # only effective before the JVM starts (local mode: the executor heap too)
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint directory.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    and the master is local (tests) a fresh local folder is made and
    registered: on a cluster a machine's own folder would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="vocaframe-ckpt-")
        spark.sparkContext.setCheckpointDir(root)  # the setting itself is fixed once a session runs
    path = root.rstrip("/")
    for p in parts:
        path = path + "/" + p
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder name under :func:`shared_dir`."""
    base = shared_dir(spark, "vocaframe")
    return f"{base}/{name}-{os.getpid()}-{os.urandom(6).hex()}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vocaframe`` importable in the Python workers (the code of the
    Arrow-batched audio steps lives in this package).

    The package is zipped once per application into the shared folder and
    added with ``addPyFile``, the programmatic ``--py-files``; Spark copies it
    to every executor, including ones started after a loss."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = shared_dir(spark, "vocaframe-py", app)
    local = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local:  # remote shared folder: stage the zip locally, Spark uploads it
        local = tempfile.mkdtemp(prefix="vocaframe-py-")
    os.makedirs(local, exist_ok=True)
    zpath = os.path.join(local, "vocaframe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)

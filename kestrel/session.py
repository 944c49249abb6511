"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kestrel") -> SparkSession:
    """Return a session tuned for the library's plans.

    On a cluster the master and the partition count come from the submit
    configuration; both arguments are only used for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "16g"))
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # wide frames (100+ columns) after one-hot encoding
        "spark.sql.codegen.maxFields": "400",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, needed=False)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, needed: bool = True) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only if unset.

    A local folder is created only when the session runs in local mode (tests,
    bench).  On a cluster an unset checkpoint dir is an error: executors can be
    lost and lineage must be cut into shared storage.  With ``needed=False`` the
    error is left to the first query that writes there.
    """
    sc = spark.sparkContext
    ship_package(spark)
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        if not needed:
            return None
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="kestrel-ckpt-", dir=os.environ.get("KESTREL_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in the Python workers (pandas UDFs and
    ``mapInPandas`` functions are pickled by module reference).

    Zips the installed package once per application and registers it with
    ``addPyFile`` — the programmatic form of ``spark-submit --py-files``;
    executors fetch the archive from the driver.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="kestrel-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "kestrel"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # the JVM may have appended a uuid folder; keep tables beside it
    return f"{base}/tables/{name or 't'}-{uuid.uuid4().hex[:12]}"

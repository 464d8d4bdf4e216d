"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


_local_roots: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "freshet", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_dir(spark: SparkSession) -> str:
    """The folder of everything this application writes between stages.

    It lies below the cluster's ``spark.checkpoint.dir``. Only a local session may
    do without that setting and gets a temporary folder: executors on other
    machines could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_root(spark)
    return f"{root.rstrip('/')}/freshet-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the application's run folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all that this application has written between stages; call it when results have been read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _own_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="freshet-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]

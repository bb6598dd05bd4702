"""Session settings and the shared folder for written intermediate tables."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app_name: str = "riskframe", **conf) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", _local_folder())
        # small tables should still use all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    session, where the driver and the executors are one machine, may fall back
    to a temporary folder.  :func:`drop_shared_folders` deletes what a job made.
    """
    return f"{_own_root(spark)}/{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_folder()
    return f"{base.rstrip('/')}/riskframe/{spark.sparkContext.applicationId}"


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    base = tempfile.mkdtemp(prefix="riskframe-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def drop_shared_folders(spark: SparkSession) -> None:
    """Deletes every intermediate table that this application wrote; call it when the job ends."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)

"""Spark session used by the command line, the bench and the tests."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "lodestone", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; the caller's settings win."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path for a query's own tables in the folder that the cluster shares, deleted when the driver's Python ends.

    Without such a folder, as in tests, below /tmp.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{(named or 'file:///tmp/lodestone-checkpoints').rstrip('/')}/lodestone-{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended; the folder stays for the cluster's own clean-up
        pass

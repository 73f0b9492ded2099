"""Session and shared-folder settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    settings = {
        "spark.master": master,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) by which Spark itself reaches a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it goes when the driver ends.

    Where that is unset, a local one does for a session whose driver is its only executor; any other has to name a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidemill")
    top = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, top)
    fs.mkdirs(p)  # what isn't there yet can't be marked
    fs.deleteOnExit(p)
    return top


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


# Fixed value: Spark's setting by which a query's shuffle files go when it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as soon as it has written what it makes, and not when the driver collects its garbage."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def checkpointed(df):
    """df, cut from its lineage by files in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, where they may not have it installed."""
    import shutil

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        top = tempfile.mkdtemp()
        shutil.copytree(here, f"{top}/src/tidemill", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{top}/tidemill", "zip", f"{top}/src"))
        _shipped.add(app)

"""Session defaults, lineage cutting and shipping of the library to the workers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "eventloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, made the context's checkpoint folder.

    A cluster must name it. Only a local session without the setting gets a
    folder of its own, which is removed when Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession, wait: float = 0.2) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner acts on what the JVM has collected, which it forces only every half hour. Long jobs of many
    steps call this after a step whose result is checkpointed, so that disk holds one step and not all.
    ``wait`` is in seconds: Python lets go of Java objects on a thread of its own, which looks every tenth of
    a second, and what watches a Python worker in a local session holds its task for two. Spark's listeners
    hold the last query until another one has ended, hence the small one.
    """
    spark.range(1).count()
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def ship_library(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_eventloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="eventloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "eventloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.join("eventloom", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._eventloom_shipped = True

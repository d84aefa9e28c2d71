"""Sessions, and the package's own code on the executors."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    base = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a Spark context.

    Spark serves the archive from the driver; nothing reads the driver's
    folder by path. Not needed if the package is installed on all machines.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomline_shipped", False):
        return
    root = Path(importlib.util.find_spec("loomline").origin).parent
    handle, path = tempfile.mkstemp(prefix="loomline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for p in sorted(root.rglob("*.py")):
            archive.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._loomline_shipped = True


def checkpointed(df):
    """``df.checkpoint()`` in the shared folder; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomline-"))
    return df.checkpoint()

"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of a few megabytes, for rows that are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of this
    machine; on a cluster that is an error, since executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The copy outlives any executor. It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_all)
    _made.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later step reads."""
    _delete(df.sparkSession, df._loomline_path)


def tidied(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are written: Spark
    deletes them when the driver collects the plans that made them."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_all() -> None:
    """Delete every table that :func:`written` made in this process."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
            return

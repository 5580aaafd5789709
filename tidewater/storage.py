"""Tables written between steps: a shared folder, cuts of the lineage, and what they leave behind."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_cleanup: set[str] = set()
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    `spark.checkpoint.dir` where the cluster sets it, or the context's checkpoint
    folder. Where neither is set a local master (tests) gets a temporary one; on a
    cluster that would be each machine's own, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Later stages start from files that every executor can read, so a lost
    executor costs a re-read and not the whole lineage.
    The files of an application are removed when its driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    release(spark)
    writer = df.write.option("compression", "zstd")  # what is written here is read once or twice, and disk is what runs out first
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewater_path = path
    return out


def fresh_path(spark: SparkSession) -> str:
    """A path of no file yet in the shared folder, removed when the driver ends."""
    base = f"{shared_dir(spark)}/tidewater-{spark.sparkContext.applicationId}"
    if base not in _cleanup:
        _cleanup.add(base)
        atexit.register(remove, spark, base)
    return f"{base}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Cuts made inside are deleted at the end, but for those handed to the function that this yields."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df._tidewater_path)
        if len(_scratch) > 1:  # then it is the outer scratch's to delete
            _scratch[-2].append(df._tidewater_path)
        return df

    _scratch.append(paths)
    try:
        yield keep
    finally:
        _scratch.pop()
        for path in paths:
            remove(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages: they are out of reach, but only a collection tells."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session is still there."""
    try:
        context = spark.sparkContext
        if context._jsc is None:
            return
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway may be gone at exit; the cluster's own cleanup takes over
        pass

"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary one on a local master only."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which is deleted when the application ends."""
    at = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # only what exists can be marked
    fs.deleteOnExit(path)
    return at


def drop(spark: SparkSession, at: str) -> None:
    """Deletes a folder that scratch() made, or one within it, which nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables of more bytes than this are read as they lie.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt over the cores if it is small and read from fewer files than there are cores, else df itself.

    A file of one row group is read by one task, whatever its size; what follows the scan then runs in one task too. Only
    tables of at most SPREAD_BYTES (the scan's own estimate) are dealt: larger ones have row groups enough, and dealing
    them out would shuffle everything.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

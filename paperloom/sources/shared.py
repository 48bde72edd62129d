"""The folder that the driver and all executors share, and folders in it that end with the driver."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all run in this process, a temporary folder."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not set_to and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(set_to or "file://" + tempfile.mkdtemp(prefix="paperloom-checkpoint-"))
    return set_to or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def passing_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/paperloom-{uuid.uuid4().hex}"

    def end() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session went before the driver
            pass

    atexit.register(end)
    return path


def spread(rows: DataFrame) -> DataFrame:
    """A table of few files, as a small one is, dealt over all cores before costly work on its rows; a larger one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows

"""What every operator needs from the session: shared storage and shipped code."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    sc = spark.sparkContext
    name = f"{_PACKAGE.name}.zip"
    if any(f.rstrip("/").endswith(name) for f in sc.listFiles):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    path = Path(tempfile.mkdtemp(prefix="paperloom-")) / name
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and all run in this process."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not set_to and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(set_to or "file://" + tempfile.mkdtemp(prefix="paperloom-checkpoint-"))
    return set_to or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table in the shared folder; Spark removes the files with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_PASSING: list[list[Scratch]] = []


@contextmanager
def passing():
    """Scratch tables that are begun inside are dropped at the end: what was made from them must be written by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for scratch in _PASSING.pop():
            scratch.keep_only()


class Scratch:
    """Tables written once in the shared folder: dropped when their operator reads them no more, the others when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/paperloom-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self._end)
        if _PASSING:
            _PASSING[-1].append(self)

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")
        self.names.remove(name)

    def keep_only(self, *names: str) -> None:
        """Drop the tables that nothing reads any more."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session went before the driver
            pass


def spread(rows: DataFrame) -> DataFrame:
    """A table of few files, as a small one is, dealt over all cores before costly work on its rows; a larger one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0

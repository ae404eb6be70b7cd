"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without that
    setting gets one of its own, a cluster without it is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="provenant-"))
    return (path or sc.getCheckpointDir()).rstrip("/") + "/provenant"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: a short plan behind it,
    safe from the loss of an executor. Spark deletes the files once no plan
    refers to them any more, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles go when the action that made them ends, not some time after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written for one call, as Parquet in the shared folder: they cut the
    lineage, survive the loss of any executor, and go when the call ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.path)

    def table(self, df: DataFrame, name: str, append: bool = False, brief: bool = False, by: str | None = None) -> DataFrame:
        """``df`` as a new table, or at the end of the one of that name. ``brief`` spares
        disk: dense files, and what was shuffled for them is deleted at once. Each value of ``by`` has its own folder."""
        path = f"{self.path}/{name}" if append else f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        with brief_shuffles(self.spark) if brief else contextlib.nullcontext():
            out = df.write.option("compression", "zstd") if brief else df.write
            out = out.partitionBy(by) if by else out
            out.mode("append" if append else "errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pv_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table before the call ends."""
        self._delete(df._pv_path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

"""Intermediate tables in the shared folder, with an owner that deletes them."""

from __future__ import annotations

import atexit
import contextlib
import weakref

from pyspark.sql import DataFrame, SparkSession

from textloom.session import scratch_path, scratch_root


class Scratch:
    """Tables of one run, in a folder of their own below ``spark.checkpoint.dir``.

    Each table cuts the lineage: what reads it later does not depend on an
    executor's disk. ``drop`` deletes tables early. ``finish`` checkpoints the result and deletes the folder; a
    folder that a lazy result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        self.tables = 0
        self.paths = weakref.WeakKeyDictionary()
        atexit.register(self._leave)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.tables:02d}-{name}"
        self.tables += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            self._delete(self.paths.pop(df))

    def finish(self, df: DataFrame) -> DataFrame:
        out = durable(df)
        self.close()
        return out

    def _leave(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.close()

    def close(self) -> None:
        atexit.unregister(self._leave)
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``checkpoint()``, in the folder the cluster names or, where it names none, the scratch root."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint(eager=True)

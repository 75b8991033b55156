"""Lineage cuts as written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset, in a local session, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="curata-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_recorded: list[list[Scratch]] = []


@contextmanager
def consumed() -> Iterator[None]:
    """All scratch tables that operators make within go at its end: a result that reads them is to be written within too."""
    made: list[Scratch] = []
    _recorded.append(made)
    try:
        yield
    finally:
        _recorded.remove(made)
        for work in made:
            work.drop("")


class Scratch:
    """Written tables of one operator run. A lost executor costs only the tasks of the stage at hand."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = self._path("")
        files.mkdirs(path)
        files.deleteOnExit(path)  # what is still needed by results goes with the driver
        for made in _recorded:
            made.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; the empty name stands for all of them."""
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)

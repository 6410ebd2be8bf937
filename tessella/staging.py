"""Lineage cuts on shared storage.

Iterative operators write each round as a Parquet table under the folder that the cluster
names in ``spark.checkpoint.dir``; every executor can read it again after a loss, and the
job computes the round once (``DataFrame.checkpoint`` would compute its last stage twice).
What was shuffled for a table is removed when the table is written, since nothing reads it again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[Staged] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests), a temporary one."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} isn't set: staged tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


class Staged:
    """A DataFrame written to shared storage; ``drop()`` removes its files."""

    def __init__(self, df: DataFrame, label: str) -> None:
        self._spark = df.sparkSession
        self.path = f"{shared_dir(self._spark)}/{label}-{uuid.uuid4().hex}"
        before = self._spark.conf.get(_CLEANUP, None)
        self._spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self._spark.conf.set(_CLEANUP, before) if before is not None else self._spark.conf.unset(_CLEANUP)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
        _written.append(self)

    def drop(self) -> None:
        if self in _written:
            _written.remove(self)
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to shared storage and returns it read back, with its lineage cut."""
    return Staged(df, label).df


def clear() -> None:
    """Removes all tables that this process staged and that are still there; for when their results are written."""
    for one in list(_written):
        one.drop()

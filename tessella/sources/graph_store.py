"""A graph kept as Parquet: writes that may be repeated, and read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.graph import merge_latest

#: Labels and edge types that the store takes.
LABELS = frozenset(("SourceObject", "Identity", "Entity", "Claim", "Conflict", "Policy", "Run", "Coverage", "region", "nation", "customer", "supplier", "orders", "part"))


class GraphStore:
    """nodes (label, id, payload) below ``path``; each write is a version, readers see the newest whole one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        root = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        fs = root.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [x.getPath() for x in fs.listStatus(root) if fs.exists(self._spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self) -> DataFrame | None:
        v = self._versions()
        return self._spark.read.parquet(f"{self._path}/v{v[-1]}") if v else None

    def upsert(self, nodes: DataFrame) -> None:
        """Adds nodes or replaces those of the same label and id; repeating a write changes nothing. Unknown labels fail."""
        unknown = nodes.where(~F.col("label").isin(*LABELS)).limit(1).collect()
        if unknown:
            raise ValueError(f"label {unknown[0]['label']} isn't allowed")
        v, old = self._versions(), self.read()
        new = nodes.select("label", "id", "payload").withColumn("wave", F.lit(1))
        every = new if old is None else old.withColumn("wave", F.lit(0)).unionByName(new)
        merge_latest(every, ["label", "id"], "wave").drop("wave").write.parquet(f"{self._path}/v{v[-1] + 1 if v else 1}")

    def missing(self, nodes: DataFrame) -> DataFrame:
        """What of ``nodes`` isn't in the store."""
        old = self.read()
        wanted = nodes.select("label", "id").distinct()
        return wanted if old is None else wanted.join(old, ["label", "id"], "left_anti")

"""A sink for ``foreachBatch`` whose batches take effect once.

A batch is written to a folder that readers don't see and then renamed to ``batch=<id>``. The names of the finished
folders are the ledger of the batches that took effect: a batch that was cut off leaves nothing that is read, and one
that runs again after it was finished is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LedgerSink:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The ledger: ids of the batches that took effect."""
        fs, root = self._fs(), self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def commit(self, batch: DataFrame, batch_id: int) -> bool:
        """Write a batch unless it took effect before; whether it did now."""
        fs, place = self._fs(), self._path(f"batch={batch_id}")
        if fs.exists(place):
            return False
        half = f"_half-{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.folder}/{half}")
        if not fs.rename(self._path(half), place) or fs.exists(self._path(f"batch={batch_id}/{half}")):
            # another writer of the same batch was first
            fs.delete(self._path(f"batch={batch_id}/{half}"), True)
            fs.delete(self._path(half), True)
            return False
        return True

    def sweep(self) -> int:
        """Delete what batches that were cut off left; only where no writer is at work."""
        fs, root = self._fs(), self._path("")
        half = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("_half-")]
        for path in half:
            fs.delete(path, True)
        return len(half)

    def rows(self, schema) -> DataFrame:
        """All rows of the batches that took effect."""
        found = [f"{self.folder}/batch={i}" for i in self.batches()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def latest(self, schema, keys: list[str], version: list[str]) -> DataFrame:
        """One row for each key: the one of the latest version."""
        rows = self.rows(schema)
        rest = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__row"))
        return newest.select(*keys, *(f"__row.{c}" for c in rest))

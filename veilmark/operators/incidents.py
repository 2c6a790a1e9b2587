"""Incidents kept as they come: the last of each site, by batches that may come again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class IncidentSink:
    """A table of the last `keep` incidents of each site, in versions in a folder that the driver and all executors share.

    A version has the rows and, in a column of their own table, the number of the last batch it holds, so a batch that comes again
    changes nothing.  Of a batch only the last `keep` of a site meet the kept ones, so work grows with the batch and not with all that
    ever came.  Later timestamps come first, and of equal ones the larger id.  One writer at a time; batches come in order of number.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 500, site: str = "site_id"):
        self.spark, self.folder, self.keep, self.site = spark, folder.rstrip("/"), keep, site

    def _versions(self) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        names = [s.getPath().getName() for s in store.listStatus(top)]
        mark = lambda n: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n) for n in names if n.isdigit() and mark(n))

    def incidents(self) -> DataFrame | None:
        """What is kept; None before the first batch."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.folder}/{versions[-1]:020d}") if versions else None

    def _last(self, rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(self.site).orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()))
        return rows.withColumn("_place", place).where(F.col("_place") <= self.keep).drop("_place")

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Take in the incidents (id, timestamp, site, ...) of a batch; whether it was new."""
        versions = self._versions()
        if versions and versions[-1] >= batch:
            return False
        kept, new = self.incidents(), self._last(rows)
        both = new if kept is None else kept.unionByName(new.select(kept.columns))
        self._last(both).write.mode("overwrite").parquet(f"{self.folder}/{batch:020d}")
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For `foreachBatch` of a streaming query."""
        return lambda rows, batch: self.add(rows, batch) and None

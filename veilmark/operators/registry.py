"""The session registry: stand-ins and their values of each session, kept as tables that batches are merged into.

A stand-in belongs to the value that the earliest batch gave it, by the batches' own names and not by when they come, and within a
batch to the least value.  So batches that come again, or in another order, or after a compaction, leave the same table.

Layout below the folder: `batches/<name>` has a batch's pairs, `bases/<number>` the pairs of all batches merged so far, each with
its batch, and `merged/<number>` those batches' names.  Whatever has no _SUCCESS mark doesn't count and is written anew.  Rows with
a null or empty stand-in are left out; a null session is a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "session string, mock string, real string, batch string"


class SessionRegistry:
    """A registry in a folder that the driver and all executors share.  One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _done(self, kind: str) -> list[str]:
        """Names of the finished parts of one kind."""
        top = self._path(kind)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        names = [s.getPath().getName() for s in store.listStatus(top)]
        return sorted(n for n in names if store.exists(self._path(kind, n, "_SUCCESS")))

    def add_pairs(self, batch: str, pairs: DataFrame) -> bool:
        """Merge `pairs` (session, mock, real) as the batch of this name; whether it was new."""
        if batch in self._done("batches") or batch in self._merged(self._base()):
            return False
        rows = pairs.select(F.col("session").cast("string").alias("session"), "mock", "real").where("mock <> ''")
        rows.groupBy("session", "mock").agg(F.min("real").alias("real")).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For `foreachBatch` of a streaming query; its batches are named by their numbers."""
        return lambda pairs, number: self.add_pairs(f"{number:020d}", pairs) and None

    def _base(self) -> str | None:
        finished = set(self._done("bases")) & set(self._done("merged"))
        return max(finished, default=None)

    def _merged(self, base: str | None) -> set[str]:
        return {r["batch"] for r in self.spark.read.parquet(f"{self.folder}/merged/{base}").collect()} if base else set()  # names only

    def _rows(self) -> tuple[DataFrame, list[str]]:
        base = self._base()
        merged = self._merged(base)
        new = [b for b in self._done("batches") if b not in merged]
        rows = self.spark.read.parquet(f"{self.folder}/bases/{base}") if base else self.spark.createDataFrame([], PAIRS)
        if new:
            name = F.element_at(F.split(F.input_file_name(), "/"), -2)
            late = self.spark.read.schema("session string, mock string, real string").parquet(*[f"{self.folder}/batches/{b}" for b in new])
            rows = rows.unionByName(late.withColumn("batch", F.url_decode(name)))
        first = rows.groupBy("session", "mock").agg(F.min(F.struct("batch", "real")).alias("first"))
        return first.select("session", "mock", "first.real", "first.batch"), sorted(merged | set(new))

    def pairs(self) -> DataFrame:
        """(session, mock, real), one row for each stand-in of a session."""
        return self._rows()[0].drop("batch")

    def compact(self) -> None:
        """Merge all batches into one base; earlier bases stay until they are removed by hand, as readers may have them open."""
        rows, names = self._rows()
        number = f"{int(self._base() or '0') + 1:010d}"
        rows.write.mode("overwrite").parquet(f"{self.folder}/bases/{number}")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.mode("overwrite").parquet(f"{self.folder}/merged/{number}")

"""Token counts (numbered operator 5): rollups kept up to date by signed deltas.

Totals by source, language and tokenizer version are additive, so a batch of changes is reduced to signed sums: inserted
documents count +1, deleted ones -1, revised ones -1 with the old and +1 with the new count.  A batch is one folder under
the rollup's path, named by its id and complete once it holds Spark's success mark; committing an id again does nothing,
and a batch that broke off is written anew.

Kept totals: `compact` adds the batches that came since to the totals kept so far and writes them, with the ids of all batches
they hold, as the next generation; only then are the folders of those batches removed.  A generation counts once its success
mark is there, so a compaction that broke off changes nothing, and one that is run again adds nothing.  `totals` is the last
generation and the batches that it doesn't hold yet, so its cost follows from what is new.  One writer at a time may compact.

Nulls: null sources and languages are groups of their own; a null text has 0 tokens and counts as a document.  Empty tables
and batches give no groups.  Groups whose documents and tokens have both come back to 0 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.stages import small_batches
from veilmark.llm.tokens import default_path, word_tokens

GROUP = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Of `docs` (doc_id, text, source, lang): doc_id, source, lang, words, subwords."""
    path = tokenizer_path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(3)]
            words = [len((t or "").encode("utf-8", "replace").split()) for t in texts]
            subwords = [len(encoder.encode(t)) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(words, pa.int64()), pa.array(subwords, pa.int64())], ["doc_id", "source", "lang", "words", "subwords"])

    rows = small_batches(docs).select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, words bigint, subwords bigint")


def signed(rows: DataFrame, sign: int, tokenizer: str, tokens: str) -> DataFrame:
    """Changes of one kind: `rows` counted `sign` times under `tokenizer` with the counts in the column `tokens`."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("docs"), (F.col(tokens) * sign).cast("bigint").alias("tokens"))


class TokenRollup:
    """The rollup under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        where, files = self._at(name)
        return files.exists(where)

    def _folders(self, kind: str) -> list[str]:
        """Names of the complete folders of this kind, in order."""
        if not self._there(""):
            return []
        where, files = self._at("")
        names = sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory())
        return [n for n in names if n.startswith(kind) and self._there(f"{n}/_SUCCESS")]

    def _kept(self) -> str | None:
        """The last generation of totals.  Its `ids` folder is written before its `sums`, whose success mark completes it."""
        return next(iter(reversed([n for n in self._folders("ids-") if self._there(f"{n.replace('ids-', 'sums-')}/_SUCCESS")])), None)

    def _held(self) -> DataFrame:
        """batch_id of the batches that the kept totals hold."""
        kept = self._kept()
        return self.spark.read.schema("batch_id string").parquet(f"{self.path}/{kept}") if kept else self.spark.createDataFrame([], "batch_id string")

    def committed(self) -> list[str]:
        """The ids of batches that aren't in the kept totals yet."""
        new = [n.removeprefix("batch-") for n in self._folders("batch-")]
        held = {r["batch_id"] for r in self._held().where(F.col("batch_id").isin(new)).collect()} if new else set()  # of those asked for
        return [n for n in new if n not in held]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add the signed `changes` once; False if the batch was there already."""
        if self._there(f"batch-{batch_id}/_SUCCESS") or not self._held().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        self._write(changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), f"batch-{batch_id}")
        return True

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{name}")

    def totals(self) -> DataFrame:
        return self._sums(self._kept(), self.committed())

    def compact(self) -> int:
        """Take all new batches into the kept totals; how many they were."""
        new, kept = self.committed(), self._kept()
        if new:
            number = int(kept.removeprefix("ids-")) + 1 if kept else 1
            ids = self._held().unionByName(self.spark.createDataFrame([(b,) for b in new], "batch_id string"))
            self._write(ids, f"ids-{number:012d}")
            self._write(self._sums(kept, new), f"sums-{number:012d}")
            kept = f"ids-{number:012d}"
        # also what a compaction that broke off after its success mark has left behind
        open_ = {f"batch-{b}" for b in self.committed()}
        past = [n for kind in ("ids-", "sums-") for n in self._folders(kind) if kept and n.split("-")[1] < kept.split("-")[1]]
        for name in [n for n in self._folders("batch-") if n not in open_] + past:
            where, files = self._at(name)
            files.delete(where, True)
        return len(new)

    def _sums(self, kept: str | None, batches: list[str]) -> DataFrame:
        parts = [f"{self.path}/batch-{b}" for b in batches] + ([f"{self.path}/{kept.replace('ids-', 'sums-')}"] if kept else [])
        rows = self.spark.read.schema(DELTAS).parquet(*parts) if parts else self.spark.createDataFrame([], DELTAS)
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

"""Lineage cuts shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.  Only a session on one machine may go without, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder that the session names and go on from there, so lost executors cost little.

    Only where `spark.checkpoint.dir` is unset and no folder was chosen yet (tests on one machine) is one made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")  # once the result is written, nobody reads the shuffles that led to it
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(name, before)


def content_key(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row, as _h1 and _h2: together they tell any two rows apart.

    The hash passes over nulls, so which columns are null goes in first.
    """
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(nulls, *columns).alias("_h1"), F.xxhash64(F.lit("second"), nulls, *columns).alias("_h2")]


def one_of_each(docs: DataFrame) -> DataFrame:
    """The distinct rows of `docs` with _h1 and _h2, dealt by them; equal rows meet before and after the shuffle."""
    first = [F.first(c).alias(c) for c in docs.columns]
    return docs.select("*", *content_key(docs.columns)).groupBy("_h1", "_h2").agg(*first)


def _plain(setting: str) -> int:
    """A number of rows or bytes; 0 for one with another unit, which is then replaced."""
    digits = setting.removesuffix("b")
    return int(digits) if digits.lstrip("-").isdigit() else 0


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on its session hands Python BATCH_ROWS rows and about BATCH_BYTES at most at once, as texts are long.

    A batch ends with the row that reaches the bytes.  Plans read both settings when they run, so they stay lowered.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = _plain(conf.get(name))
        if not 0 < held <= most:
            conf.set(name, f"{most}b" if "Bytes" in name else str(most))
    return df


def one_row_each(df: DataFrame, *keys: str) -> DataFrame:
    """(*keys, text): of the rows of `df` with equal keys the one whose text has the least hash, chosen before and after the shuffle."""
    return df.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

"""The folder that the driver and all executors share, and results written there once to be read by several branches of a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.  Only a session on one machine may go without, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df`, worked out now, written to the shared folder and read from there: for what several branches need, such as findings,
    so that texts are scanned once and a lost executor costs little."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.select("*").checkpoint(eager=True)

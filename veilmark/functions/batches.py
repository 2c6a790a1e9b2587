"""Sizes of the batches that Python is handed, and their nested columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on its session hands Python BATCH_ROWS rows and about BATCH_BYTES at most at once, so a worker's memory follows
    from a few texts and not from ten thousand.  Plans read both settings when they run, so they stay lowered."""
    conf = df.sparkSession.conf
    for name, most, unit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, ""), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "b")):
        held = conf.get(name).removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):  # other units are replaced
            conf.set(name, f"{most}{unit}")
    return df


def of_rows(lists: pa.Array, *fields: str) -> Iterator[list[tuple]]:
    """Of each row of a column of lists of structs, these fields of its structs; their strings are taken from Arrow column by column."""
    held = lists.flatten()
    flat = list(zip(*(held.field(name).to_pylist() for name in fields)))
    at = 0
    for size in pc.list_value_length(lists).to_pylist():
        yield flat[at : at + (size or 0)]
        at += size or 0

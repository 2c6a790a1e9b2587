"""Exact top-k search (numbered operator 8) with vector-approximation files.

Each vector's components are quantised to cells of one byte, whose width follows from the vector's own largest component;
cells and exact vectors are written as columns of one table, so a scan of the cells doesn't read the vectors.  A row's inner
product with a query lies within bounds that follow from its cells alone.  Blocks of queries scan blocks of cells and keep the
rows whose best possible score reaches the k-th sure one of the block; over all blocks, the k-th sure score of each query
then leaves only rows that can still be among its k best.  Their exact vectors are read in the order of their bounds, in two
turns: the first few of each query, and then only those whose bound reaches the k-th score found so far.

Nulls: vectors that are null or hold null or non-finite components take no part, neither as queries nor as rows; vectors of
another length than the query's take no part in its search.  Rows with one id are one candidate with the best of their
scores, and one query, which is the smallest of their vectors; a query never finds its own id.  Ties go to the smaller id.
Empty tables give no rows.  Components are whole numbers held as doubles, so those of any finite float32 are exact.  Products
that may not fit 64 bits are added up as whole numbers of any size: order is exact up to 38 digits, and the reported score
is the nearest 64-bit integer.  A vector with a component beyond 1e150 takes no part, as its products pass a double's range.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.stages import cut, shared_folder, small_batches

MOST, DIGITS = 1e150, 38
FIRST = 2  # times k rows of a query are read exactly before its other rows
ROW_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 16384, 1024, 128
FOUND = "query_id bigint, row bigint, vec_id bigint, low double, high double"


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component, as doubles; rows that take no part are gone."""
    embedding = F.col("embedding")
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= F.lit(MOST)))
    kept = vectors.where(embedding.isNotNull() & F.col("vec_id").isNotNull() & whole)
    scaled = F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double"))
    # from 2**53 on doubles are whole, and floor() would pass 64 bits
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("q"))


def with_cells(rows: DataFrame) -> DataFrame:
    """`rows` (vec_id, q) with width, a power of two of at least 2, and cells, floor(q / width) in one byte each."""
    most = F.coalesce(F.array_max(F.transform("q", lambda x: F.abs(x))), F.lit(0.0)) + 1
    bits = F.greatest(F.floor(F.log2(most / 128.0) + 1e-9) + 1, F.lit(1))
    rows = rows.withColumn("width", F.pow(F.lit(2.0), bits.cast("double")))
    return rows.withColumn("cells", F.transform("q", lambda x: F.floor(x / F.col("width")).cast("tinyint")))


def exact_products(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, exact) of `pairs` (query_id, vec_id, asked, q), exact being held to DIGITS digits."""
    limit = 10**DIGITS - 1

    def product(a: np.ndarray, b: np.ndarray) -> int:
        if np.linalg.norm(a) * np.linalg.norm(b) < 2.0**62:
            return int(np.dot(a.astype(np.int64), b.astype(np.int64)))
        return max(-limit, min(limit, sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(i)] for i in (2, 3)]
            exact = [Decimal(product(a, b)) for a, b in zip(*each)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact, pa.decimal128(DIGITS, 0))], ["query_id", "vec_id", "exact"])

    return small_batches(pairs).select("query_id", "vec_id", "asked", "q").mapInArrow(run, f"query_id bigint, vec_id bigint, exact decimal({DIGITS},0)")


def bounds(queries: np.ndarray, cells: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the inner products, one row a query; a little wider than they need be, for rounding."""
    queries, cells = queries.astype(np.float64), cells.astype(np.float64)
    floor = (queries @ cells.T) * width[None, :]
    slack = 1e-12 * np.linalg.norm(queries, axis=1)[:, None] * (np.linalg.norm(cells, axis=1) * width)[None, :]
    high = floor + np.maximum(queries, 0).sum(1)[:, None] * (width - 1)[None, :] + slack
    low = floor + np.minimum(queries, 0).sum(1)[:, None] * (width - 1)[None, :] - slack
    most = 10.0**DIGITS  # beyond it exact products are held equal, so none of them may be left out
    return np.clip(low, -most, most), np.clip(high, -most, most)


def near_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cells: np.ndarray, width: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query places, row places, low, high) of the rows that can be among a query's k best of this block."""
    names, of = np.unique(ids, return_inverse=True)
    found = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        low, high = bounds(queries[at : at + QUERIES_AT_ONCE], cells, width)
        for i in range(len(low)):
            own = ids == query_ids[at + i]
            low[i, own] = high[i, own] = -np.inf
            sure = low[i]
            if len(names) < len(ids):  # an id counts once, by its best row
                sure = np.full(len(names), -np.inf)
                np.maximum.at(sure, of, low[i])
            least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
            near = np.flatnonzero((high[i] >= least) & ~own)
            found.append((np.full(len(near), at + i), near, low[i, near], high[i, near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the highest integer inner product, for all rows where `is_query`."""
    spark = vectors.sparkSession
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    numbered = integer_vectors(vectors, scale).withColumns({"asks": F.coalesce(is_query, F.lit(False)), "row": F.monotonically_increasing_id()})
    with_cells(numbered).write.parquet(path)
    table = spark.read.parquet(path)
    queries = cut(table.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("asked")))
    row_blocks, query_blocks = max(1, math.ceil(table.count() / ROW_BLOCK)), max(1, math.ceil(queries.count() / QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = table.select("row", "vec_id", "cells", "width", F.size("cells").alias("dims"), F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("row_block"), every(query_blocks).alias("query_block"))
    asked = queries.select("query_id", "asked", F.size("asked").alias("dims"), F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"), every(row_blocks).alias("row_block"))
    keys = ["dims", "row_block", "query_block"]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
        if left.num_rows and right.num_rows and left["dims"][0].as_py():
            dims = left["dims"][0].as_py()
            flat = lambda x: x.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            names, ids, numbers = left["query_id"].to_numpy(), right["vec_id"].to_numpy(), right["row"].to_numpy()
            q, r, low, high = near_in_block(names, flat(left["asked"]), ids, flat(right["cells"]), right["width"].to_numpy().astype(np.float64), k)
            parts = [names[q], numbers[r], ids[r], low, high]
        return pa.table(parts, names=["query_id", "row", "vec_id", "low", "high"])

    found = cut(asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(scan, FOUND))
    # the k-th sure score of each query over all blocks
    sure = found.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc(), "vec_id"))
    least = sure.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("least"))
    open_ = cut(found.join(least, "query_id").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_id", "row", "vec_id", "high"))
    # exact vectors in the order of their bounds: the most promising first, then only what can still pass the k-th of those
    products = lambda pairs: exact_products(pairs.join(table.select("row", "q"), "row").join(queries, "query_id"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("high").desc(), "vec_id", "row"))
    early = cut(open_.withColumn("turn", turn).where(F.col("turn") <= FIRST * k).select("query_id", "row", "vec_id"))
    known = cut(products(early).groupBy("query_id", "vec_id").agg(F.max("exact").alias("exact")))
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "vec_id"))
    sure_now = known.withColumn("place", kth).where(F.col("place") == k).select("query_id", F.col("exact").cast("double").alias("passed"))
    late = open_.join(early.select("query_id", "row"), ["query_id", "row"], "left_anti").join(sure_now, "query_id", "left").where(F.col("passed").isNull() | (F.col("high") >= F.col("passed")))
    scored = known.unionByName(products(late)).groupBy("query_id", "vec_id").agg(F.max("exact").alias("exact"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "vec_id"))
    score = F.greatest(F.least("exact", F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("bigint")
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))

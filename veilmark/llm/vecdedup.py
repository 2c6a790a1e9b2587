"""Embedding near-dedup (numbered operator 6) by collision-counting projections.

Vectors are projected on `PROJECTIONS` random directions.  Sorted by the first, they fall into blocks of `BLOCK`; a pair
within that projection's wide window meets in exactly one pair of blocks.  There the pair's collisions are counted: the
projections in which the two lie within a query-centred window.  Pairs that reach the required count are verified by their
cosine in double precision.  Windows and count are calibrated on random differences of exactly the threshold's length
against the very directions used, so that a pair at the threshold is missed in about one case of fifty; closer pairs are
missed less often.

Vectors that are equal up to a power of two are one class and are compared once; a class counts as many links as it has vectors.  A pair of blocks
returns the links' numbers and a spanning forest, not the links, so a group of near copies costs rows in proportion to its
size.  The copies of a row grow with the blocks in its window; the comparison of all with all stays quadratic, in blocks.

Nulls: vectors that are null, zero or hold null or non-finite components link with nothing, and vectors of different
lengths don't link.  Rows with a null id link with nothing and get null components.  Rows that share an id are one
vector with several rows.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.components import components
from veilmark.llm.stages import cut

PROJECTIONS, DENSE, BLOCK, SEED = 24, 16, 4096, 20240229
STEPS = 16  # a window is so many steps of the 16-bit projections


def directions(dims: int, seed: int = SEED) -> np.ndarray:
    r = np.random.default_rng(seed + dims).standard_normal((PROJECTIONS, dims))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def calibrate(dims: int, threshold: float, seed: int = SEED) -> tuple[float, float, int]:
    """The first projection's window, the others' window and the least count, for unit vectors of cosine `threshold`."""
    rng, r = np.random.default_rng(seed), directions(dims, seed)
    away = rng.standard_normal((8000, dims))
    away *= math.sqrt(2 - 2 * threshold) / np.linalg.norm(away, axis=1, keepdims=True)
    gaps = np.abs(away @ r.T)
    wide, window = float(np.quantile(gaps[:, 0], 0.993)) + 1e-9, float(np.quantile(gaps, 0.95)) + 1e-9
    count = int(np.quantile((gaps <= window).sum(1), 0.007, method="lower"))
    return wide, window, max(1, count)


def link_block(left: np.ndarray, right: np.ndarray, lp: np.ndarray, rp: np.ndarray, wide: float, window: float, count: int, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (left rows, right rows) that link; each pair once.  left, right: unit vectors; lp, rp: their projections."""
    step = window / STEPS
    a, b = np.clip(np.round(lp / step), -16000, 16000).astype(np.int16), np.clip(np.round(rp / step), -16000, 16000).astype(np.int16)
    bt = np.ascontiguousarray(b.T)
    first = int(math.ceil(wide / step)) + 1
    chunk = max(1, 2_000_000 // max(1, len(right)))
    for at in range(0, len(left), chunk):
        rows = slice(at, min(len(left), at + chunk))
        hits = np.zeros((rows.stop - at, len(right)), dtype=np.int8)
        for j in range(DENSE):
            hits += np.abs(a[rows, j][:, None] - bt[j][None, :]) <= STEPS + 1
        keep = hits >= count - (PROJECTIONS - DENSE)
        keep &= np.abs(a[rows, 0][:, None] - bt[0][None, :]) <= first
        if same:
            keep &= np.arange(at, rows.stop)[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(keep)
        if not len(x):
            continue
        got = hits[x, y].astype(np.int16)
        x = x + at
        for j in range(DENSE, PROJECTIONS):
            got += np.abs(a[x, j] - bt[j][y]) <= STEPS + 1
        x, y = x[got >= count], y[got >= count]
        if len(x) > 0.02 * keep.size:
            cosines = (left[rows] @ right.T)[x - at, y]
        else:
            cosines = np.concatenate([np.einsum("ij,ij->i", left[x[i : i + 50000]], right[y[i : i + 50000]]) for i in range(0, len(x), 50000)] or [np.zeros(0)])
        linked = cosines >= threshold
        yield x[linked], y[linked]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of nodes 0 to n-1, the smallest node that each can reach by the pairs."""
    root = np.arange(n)
    if not pairs:
        return root
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return root


def near_vectors(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    embedding = F.col("embedding")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), embedding.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # divided by a power of two, which is exact and leaves the cosine as it is: squares neither vanish nor pass a double's
    # range, and v, 2v and 4v are one class
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).cast("double"))
    scaled = F.transform(F.array(power), lambda p: F.transform("embedding", lambda x: x.cast("double") / p + F.lit(0.0)))[0]
    rows = rows.withColumn("embedding", F.when(F.col("usable"), scaled))
    rows = rows.withColumn("digest", F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256))
    distinct_rows = rows.where("usable").select("vec_id", "digest", "embedding")
    # a class of equal vectors: its smallest id and its number of different ids
    class_of = distinct_rows.select("digest", "vec_id").distinct().groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    one = distinct_rows.groupBy("digest").agg(F.any_value("embedding").alias("embedding")).join(class_of, "digest")
    reps = cut(one.select("digest", "rep", "weight", F.col("embedding").alias("x"), F.size("embedding").alias("dims")))
    shapes = [r["dims"] for r in reps.select("dims").distinct().collect()]  # lengths of vectors: a handful
    found = None
    for dims in shapes:
        part = _links(reps.where(F.col("dims") == dims), dims, threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "kind int, a string, b string, links bigint")
    found = cut(found)
    links = found.where("kind = 0").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    named = class_of.select("digest", "rep")
    trees = found.where("kind = 1").join(named.withColumnsRenamed({"digest": "a", "rep": "first"}), "a").join(named.withColumnsRenamed({"digest": "b", "rep": "second"}), "b")
    edges = trees.select(F.col("first").alias("a"), F.col("second").alias("b"))
    shared = distinct_rows.select("vec_id", "digest").distinct().join(named, "digest").where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    member = components(edges.unionByName(shared))
    out = rows.select("vec_id", "digest").join(class_of.select("digest", "weight"), "digest", "left").join(links, "digest", "left")
    out = out.join(member, out["vec_id"] == member["node"], "left")
    n_links = F.when(F.col("weight").isNotNull(), F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, dims: int, threshold: float, block: int) -> DataFrame:
    """kind 0: (a, links) adds to the links of class a; kind 1: (a, b) is an edge of a spanning forest."""
    r = directions(dims)
    wide, window, count = calibrate(dims, threshold)
    first = r[0].tolist()
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(v) for v in first]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    placed = reps.select("digest", "weight", "x", (dot / norm).alias("at"))
    n = placed.count()
    blocks = max(1, math.ceil(n / block))
    cuts = sorted(set(placed.approxQuantile("at", [i / blocks for i in range(1, blocks)], 0.02 / blocks))) if blocks > 1 else []
    lows, highs = [-math.inf, *cuts], [*cuts, math.inf]
    # the blocks up to which, and from which on, a block's rows can lie within the wide window
    last = [max(j for j in range(len(lows)) if lows[j] <= highs[i] + wide) for i in range(len(lows))]
    earliest = [min(h for h in range(len(lows)) if last[h] >= i) for i in range(len(lows))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts)
        for batch in batches:
            own = np.searchsorted(edges, batch.column("at").to_numpy(zero_copy_only=False), side="right")
            take, low, high = [], [], []
            for row, i in enumerate(own.tolist()):
                for j in range(earliest[i], last[i] + 1):
                    take.append(row)
                    low.append(min(i, j))
                    high.append(max(i, j))
            copied = batch.take(pa.array(take, pa.int64())) if take else batch.slice(0, 0)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(own[take], pa.int32()), *(copied.column(k) for k in ("digest", "weight", "x"))], ["low", "high", "own", "digest", "weight", "x"])

    dealt = placed.mapInArrow(deal, "low int, high int, own int, digest string, weight bigint, x array<double>")

    def compare(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        projected, own = x @ r.T, table["own"].to_numpy()
        weight, digest = table["weight"].to_numpy(), table["digest"].to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links, pairs = np.zeros(len(x), dtype=np.int64), []
        for i, j in link_block(x[left], x[right], projected[left], projected[right], wide, window, count, threshold, low == high):
            i, j = left[i], right[j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            pairs.append((i, j))
        root = forest(len(x), pairs)
        some, hung = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(hung), np.int32)])
        a = np.concatenate([digest[some], digest[hung]])
        b = np.concatenate([digest[some], digest[root[hung]]])
        return pa.table({"kind": pa.array(kinds), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "links": pa.array(np.concatenate([links[some], np.zeros(len(hung), np.int64)]))})

    return dealt.groupBy("low", "high").applyInArrow(compare, "kind int, a string, b string, links bigint")

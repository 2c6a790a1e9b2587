"""Filter interaction audit: what each filter removes at each step of every order in which the filters may run.

A document's failures are a mask of five bits, so a part of the corpus is at most 32 cells of counts (times two labels), and all
120 orders follow from the cells.  Orders are visited by adjacent transpositions, so from one order to the next only the two
steps that changed places are worked out again; each filter's Shapley sum accumulates along the walk.

Texts are read once, by column functions.  The table-wide filter compares hashes (SHA-256) by grouping; documents are never
collected: what meets is a fixed-width row a document, counted before and after each shuffle, so copies of one text don't meet in
one task.  Null texts are empty texts and null languages the part ''.  Null ids are neither smaller than another id nor larger,
so such a document isn't removed as a copy and removes none; equal ids aren't smaller than each other.  A document is good or
toxic if any row of labels with its id says so; null ids have no labels.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.stages import cut

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(text: Column) -> Column:
    """The bits of the four filters that see one text: A few words, B few distinct ones, C capitals, D symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    sized = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    symbols = text.rlike("[#$%&*|]")

    def bits(s: Column) -> Column:
        fails = [s["n"] < 100, 100 * s["distinct"].cast("long") < 80 * s["n"].cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), symbols]
        return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))

    return F.get(F.transform(sized, bits), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents by language and the filters they fail."""
    text = F.coalesce("text", F.lit(""))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1), F.lit(False))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("toxic"))
    seen = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    seen = seen.select("doc_id", "part", own_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(F.col("text"), 256)).alias("content"))
    counted = cut(seen.groupBy("doc_id", "part", "mask", "content").agg(F.count(F.lit(1)).alias("n")))
    first = counted.where("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = counted.join(first, ["content", "doc_id"], "left").join(said, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    lots = lambda flag: F.sum(F.when(F.coalesce(flag, F.lit(False)), F.col("n")).otherwise(0))
    return told.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"), lots("good").alias("good"), lots("toxic").alias("toxic"))


def adjacent_orders(n: int) -> Iterator[tuple[list[int], int]]:
    """Every order of 0..n-1, each from the one before by one swap of neighbours, with the place of the swap (-1 at first).

    The largest number that can move in its direction moves past its neighbour; larger ones then turn round.
    """
    order, step = list(range(n)), [-1] * n
    yield order, -1
    while True:
        moving = [(x, i) for i, x in enumerate(order) if 0 <= i + step[x] < n and order[i + step[x]] < x]
        if not moving:
            return
        x, i = max(moving)
        j = i + step[x]
        order[i], order[j] = order[j], order[i]
        for larger in range(x + 1, n):
            step[larger] = -step[larger]
        yield order, min(i, j)


def audit(counts: list[tuple[int, int, int, int]], n: int = len(FILTERS)) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique fails, good lost, toxic lost, shapley) from (mask, n, good, toxic) cells."""
    all_of = [sum(c[1] for c in counts if c[0] >> f & 1) for f in range(n)]
    alone = [sum(c[1] for c in counts if c[0] == 1 << f) for f in range(n)]
    total = sum(c[1] for c in counts)
    shapley, visited = [0] * n, []
    steps: list[tuple[int, int, int]] = [(0, 0, 0)] * n  # removed, good lost, toxic lost

    def removed(before: int, f: int) -> tuple[int, int, int]:
        gone = [c for c in counts if not c[0] & before and c[0] >> f & 1]
        return sum(c[1] for c in gone), sum(c[2] for c in gone), sum(c[3] for c in gone)

    for order, at in adjacent_orders(n):
        before = sum(1 << f for f in order[: max(at, 0)])
        for i in range(n) if at < 0 else (at, at + 1):
            steps[i] = removed(before, order[i])
            before |= 1 << order[i]
        for f, (gone, _, _) in zip(order, steps):
            shapley[f] += gone
        visited.append((tuple(order), tuple(steps)))
    for order, done in visited:
        left = total
        for i, (f, (gone, good, toxic)) in enumerate(zip(order, done)):
            left -= gone
            yield "".join(FILTERS[x] for x in order), i + 1, left, gone, all_of[f] - gone, alone[f], good, toxic, shapley[f]


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of filters and step, 600 a part, zeros included.  A part's cells are 32 at most."""
    packed = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(part, *row) for row in audit([(c["mask"], c["n"], c["good"], c["toxic"]) for c in counts.as_py()])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return packed.mapInArrow(walk, OUT)

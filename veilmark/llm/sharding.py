"""Sharding by histogram sort (numbered operator 4), in DataFrame functions only.

Rows are ordered by a 62-bit key: the CRC-32 of the text, 16 bits of a hash of the id, then 14 bits of a hash of a row number
that is written with the key.  Equal texts therefore lie next to each other, and a group of copies is divided only where a
boundary falls into it, also where its rows share their id or have none.  Each round counts the exact bytes
below candidate boundaries in all partitions at once (a grouped sum with partial sums), keeps for each boundary the one cell
in which it lies, and divides that cell into finer candidates until all lie within the tolerance; then rows move once.
The first round has 4096 candidates, each later one 256 for each boundary still open, so a round's counts stay small.

Nulls: a null text has no bytes and counts 1.  Which of the rows with the same id and text go to which of two
shards is not defined.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.stages import cut

KEY_BITS, FIRST_BITS, ROUND_BITS, SALT_BITS = 62, 12, 8, 14


def shard_key(crc: Column, identity: Column, row: Column) -> Column:
    """`row` tells rows with equal texts and ids apart."""
    middle = F.xxhash64(identity).bitwiseAND(F.lit((1 << (30 - SALT_BITS)) - 1))
    salt = F.xxhash64(row).bitwiseAND(F.lit((1 << SALT_BITS) - 1))
    return F.shiftleft(crc.cast("long"), 30).bitwiseOR(F.shiftleft(middle, SALT_BITS)).bitwiseOR(salt)


def splitters(keyed: DataFrame, parts: int, tolerance: float) -> list[int]:
    """`parts`-1 keys; rows with a key of at least the i-th lie beyond the i-th boundary.  `keyed` has key and size."""
    total = keyed.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    goals = [total * (i + 1) / parts for i in range(parts - 1)]
    allowed = tolerance * total / parts
    state = [(0, 0) for _ in goals]  # of each goal: its cell's first key, the bytes below that
    shift = KEY_BITS
    found: list[int | None] = [None] * len(goals)
    while shift > 0 and any(x is None for x in found):
        width = min(FIRST_BITS if shift == KEY_BITS else ROUND_BITS, shift)
        open_cells = sorted({state[i][0] >> shift for i in range(len(goals)) if found[i] is None})
        rows = keyed if shift == KEY_BITS else keyed.where(F.shiftright("key", shift).isin(open_cells))
        shift -= width
        counted = rows.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("bytes")).collect()  # at most parts * 2**ROUND_BITS rows
        sums = {r["cell"]: r["bytes"] for r in counted}
        inside: dict[int, list[int]] = {}
        for cell in sorted(sums):
            inside.setdefault(cell >> width, []).append(cell)
        for i, goal in enumerate(goals):
            if found[i] is not None:
                continue
            parent, below = state[i][0] >> (shift + width), state[i][1]
            first = state[i][0]
            for cell in inside.get(parent, []):
                if below + sums[cell] > goal:
                    first = cell << shift
                    break
                below += sums[cell]
                first = (cell + 1) << shift
            state[i] = (first, below)
            size = sums.get(first >> shift, 0)
            if goal - below <= allowed:
                found[i] = first
            elif below + size - goal <= allowed:
                found[i] = first + (1 << shift)
    return [x if x is not None else (state[i][0] if goals[i] - state[i][1] <= 0.5 * total / parts else state[i][0] + 1) for i, x in enumerate(found)]


def shard_rows(docs: DataFrame, shards: int = 16, ranges: int = 16, tolerance: float = 0.0005) -> DataFrame:
    """Of `docs` (doc_id, text): doc_id, size, text_crc32, key, shard, slot; every shard is sorted in `ranges` ranges.

    A shard's slots need its rows in order; so each is divided in `ranges` finer ranges by the same search, numbered each by
    itself, and shifted by the rows of the ranges before.  The table of ranges has `shards * ranges` rows and no more.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = docs.select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    keyed = cut(sized.withColumn("key", shard_key(F.col("text_crc32"), F.col("doc_id"), F.monotonically_increasing_id())))
    bounds = splitters(keyed, shards * ranges, tolerance)
    shard_bounds = bounds[ranges - 1 :: ranges]
    inner = [bounds[s * ranges : s * ranges + ranges - 1] for s in range(shards)]
    shard = sum((F.col("key") >= F.lit(b)).cast("int") for b in shard_bounds) if shard_bounds else F.lit(0)
    own = F.element_at(F.array(*[F.array(*[F.lit(b).cast("long") for b in x]) if x else F.array().cast("array<bigint>") for x in inner]), F.col("shard") + 1)
    dealt = keyed.withColumn("shard", shard.cast("int")).withColumn("part", F.size(F.filter(own, lambda b: b <= F.col("key"))))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_slot"))
    within = Window.partitionBy("shard", "part").orderBy("key", "doc_id", "size")
    numbered = dealt.withColumn("place", F.row_number().over(within) - 1)
    # at most shards * ranges rows
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("first_slot") + F.col("place")).cast("long").alias("slot"))

"""Packing token sequences (numbered operator 7): first-fit decreasing with a tournament tree of bin capacities.

A document's ids and its end id are cut into pieces of `capacity` ids and a last, shorter one.  Pieces are dealt at random
into groups of about `group_pieces`; within a group, from long to short, each goes into the first sequence that has room,
found in a tree whose inner nodes hold the largest room below them.  Groups are independent, so packing scales by groups,
and a hot document id or repeated rows spread over all of them (the deal is by row, not by id).

Nulls: a null text is an empty one, which is the end id alone; a null id is carried along.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.stages import cut, small_batches
from veilmark.llm.tokens import default_path, word_tokens

CAPACITY, END_ID, GROUP_PIECES = 4096, 2, 8192


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item; `lengths` must not rise and must be within `capacity`."""
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)  # a node's room: the most that any bin below it has left
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        where[i], offset[i] = node - leaves, capacity - room[node]
        left = room[node] = room[node] - size
        while node > 1:
            other = room[node ^ 1]
            node //= 2
            best = left if left > other else other
            if room[node] == best:
                break
            room[node] = left = best
    return where, offset


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the piece's ids."""
    path = tokenizer_path or default_path()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_tokens(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for column, x in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None)):
                        column.append(x)
            columns = [pa.array(out[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:5])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return small_batches(docs).select("doc_id", "text").mapInArrow(cut_up, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    held = cut(pieces.withColumn("deal", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(held.count() / group_pieces))
    held = held.withColumn("pack_group", F.pmod(F.xxhash64("deal", F.lit(7)), F.lit(groups)))
    names = [c for c in pieces.columns]

    def pack(table: pa.Table) -> pa.Table:
        length, deal = table["length"].to_numpy(), table["deal"].to_numpy()
        order = np.lexsort((deal, -length))
        where, offset = first_fit_decreasing(length[order], capacity)
        group = int(table["pack_group"][0].as_py())
        sorted_rows = table.select(names).take(pa.array(order))
        return sorted_rows.append_column("sequence_id", pa.array(where + (group << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return held.groupBy("pack_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, with_ids), capacity, group_pieces)

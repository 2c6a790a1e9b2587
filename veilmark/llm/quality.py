"""Quality classifier (numbered operator 10): a weak-label model trains a hashed linear scorer.

Ten overlapping heuristic labellers look for signs of junk: runs of marks, table bars, shouting, stuttering, repeated word
triples, poor vocabulary, glued words and texts without words.  Expectation-maximisation over the vote patterns of all
documents estimates how accurate each is.  The posterior labels of a bounded sample train a linear scorer on hashed word
shapes, by the share of words that have them, and on the same signs in steps, which then scores every whole text.  No given
label takes part.

Nulls: a null text is an empty one; empty texts are rejected.  Repeated rows get equal scores.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veilmark.llm.stages import one_row_each, small_batches
from veilmark.llm.textblocks import WordBlock, blocks, mix64
from veilmark.llm.weaklabel import LabelModel, LinearScorer, train_scorer

BUCKETS, SAMPLE = 1 << 16, 8000
SIGNS = ["marks", "symbols", "bars", "shout", "exclaim", "stutter", "triples", "poor_words", "long_words", "no_words"]
# From which value a sign counts as a vote for junk.
LIMITS = {"marks": 0.10, "symbols": 0.12, "bars": 0.08, "shout": 0.25, "exclaim": 0.15, "stutter": 0.06, "triples": 0.20, "poor_words": 0.60, "long_words": 14.0, "no_words": 0.5}
_CLASS = np.zeros(256, dtype=np.uint8)  # 1 lower-case letter, 2 capital, 3 digit, 4 other byte of a letter, 5 mark
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


def text_signs(raws: list[bytes]) -> tuple[np.ndarray, WordBlock]:
    """A row of signs for each text, and its words."""
    block = WordBlock(raws, lower=False)
    data, start, end, at = block.bytes, block.start, block.end, block.offsets
    kind = _CLASS[data]
    words = np.diff(at)
    many = np.maximum(words, 1)
    total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    per_text = lambda x: (s := total(x))[at[1:]] - s[at[:-1]]
    inside = lambda x: (s := total(x))[end] - s[start]
    capitals, small, marks = inside(kind == 2), inside(kind == 1), inside(kind == 5)
    last, before = data[end - 1], data[np.maximum(end - 2, 0)]
    doubled = (end - start >= 2) & (last == before) & (_CLASS[last] == 5) & (last != 46)
    first_of_text = np.zeros(len(start), dtype=bool)
    first_of_text[at[:-1][words > 0]] = True
    same = np.zeros(len(start), dtype=bool)
    same[1:] = block.hashes[1:] == block.hashes[:-1]
    same &= ~first_of_text
    n_bytes = np.maximum(per_text(end - start), 1)
    triples, poor = np.zeros(len(raws)), np.zeros(len(raws))
    h = block.hashes
    third = mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xD1B54A32D192ED03)) if len(h) >= 3 else h[:0]
    for i in np.flatnonzero(words >= 6):
        a, b = at[i], at[i + 1]
        triples[i] = 1 - len(np.unique(third[a : b - 2])) / (b - 2 - a)
        if b - a >= 20:
            # distinct words against what a text of this length can do with
            poor[i] = 1 - min(1.0, len(np.unique(h[a:b])) / (b - a) ** 0.85)
    signs = np.stack(
        [per_text(doubled) / many, per_text(marks) / n_bytes, per_text((end - start == 1) & (data[start] == 124)) / many, per_text((capitals >= 2) & (small == 0)) / many,
         per_text((last == 33)) / many, per_text(same) / many, triples, poor, n_bytes / many * (words > 0), (words == 0).astype(float)],
        axis=1,
    )
    return signs, block


def patterns(signs: np.ndarray) -> np.ndarray:
    return sum((signs[:, j] >= LIMITS[s]).astype(np.int64) << j for j, s in enumerate(SIGNS))


def shape_features(signs: np.ndarray, block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: each word shape with the step of its share, each sign with its step."""
    data, start, end, at = block.bytes, block.start, block.end, block.offsets
    kind = _CLASS[data].astype(np.uint64)
    # a shape: class of the first byte, classes of the last three, length in steps
    code = kind[start] if len(start) else np.zeros(0, np.uint64)
    for back in (1, 2, 3):
        code = code * np.uint64(8) + kind[np.maximum(end - back, start)]
    code = code * np.uint64(16) + np.minimum(end - start, 45).astype(np.uint64) // np.uint64(3)
    out, offsets = [], [0]
    steps = np.minimum(signs / np.array([LIMITS[s] for s in SIGNS]) * 4, 12).astype(np.int64)
    base = np.arange(len(SIGNS)) * 16
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        names, counts = np.unique(code[a:b], return_counts=True)
        share = counts / max(1, b - a)
        often = share >= 0.05
        step = np.minimum(np.log2(share[often] / 0.05), 5).astype(np.uint64)
        shaped = mix64(names[often] * np.uint64(8) + step + np.uint64(1 << 40)) % np.uint64(BUCKETS - 256)
        got = np.unique(np.concatenate([base + steps[i], shaped.astype(np.int64) + 256]))
        out.append(got)
        offsets.append(offsets[-1] + len(got))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(offsets)


@dataclass
class QualityModel:
    label_model: LabelModel
    scorer: LinearScorer


def fit_quality(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learn from all `docs` (doc_id, text); the scorer is fitted on `sample` of them, chosen by a hash of the id.

    Of rows that share an id, one is in the sample; rows without an id count in the votes only.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(1 << len(SIGNS), dtype=np.int64)
            for _, _, raws in blocks(batch.column(0)):
                counts += np.bincount(patterns(text_signs(raws)[0]), minlength=len(counts))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["pattern", "n"])

    seen = small_batches(docs).select("text").mapInArrow(vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 2**voters rows at most
    every = np.arange(1 << len(SIGNS))
    counts = np.zeros(len(every))
    for r in seen:
        counts[r["pattern"]] = r["n"]
    model = LabelModel(SIGNS, absence=0.25).fit(every, counts, first_hit=(0.002, 0.3), prior=0.1, steadiness=0.3)
    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raws in blocks(batch.column(0)):
                signs, block = text_signs(raws)
                got, offsets = shape_features(signs, block)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(patterns(signs), pa.int64()), lists], ["pattern", "buckets"])

    # at most `sample` rows: one of each id
    rows = one_row_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id").select("text")
    table = rows.mapInArrow(features, "pattern bigint, buckets array<int>").toArrow()
    lists = table["buckets"].combine_chunks()
    if not table.num_rows:
        return QualityModel(model, train_scorer(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), np.zeros(0), BUCKETS, 0.0))
    target = model.posterior(table["pattern"].to_numpy())
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return QualityModel(model, train_scorer(lists.flatten().to_numpy().astype(np.int64), offsets, target, np.ones(len(target)), BUCKETS, screen=0.01))


def score_quality_rows(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs`, all their columns kept, with score; an own column of that name gives way."""
    scorer = docs.sparkSession.sparkContext.broadcast(model.scorer)  # 8 bytes a bucket
    rows = small_batches(docs).drop("score")
    place = rows.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, raws in blocks(batch.column(place)):
                signs, block = text_signs(raws)
                junk = scorer.value.scores(*shape_features(signs, block))
                found.append(np.where(signs[:, -1] > 0, 0.0, 1 - junk))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*batch.schema.names, "score"])

    return rows.mapInArrow(score, StructType([*rows.schema, StructField("score", DoubleType())]))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Of `docs` (doc_id, text): doc_id, score (1: good), keep."""
    return score_quality_rows(docs.select("doc_id", "text"), model).select("doc_id", "score", (F.col("score") >= 0.5).alias("keep"))

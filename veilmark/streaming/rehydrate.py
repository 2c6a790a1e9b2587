"""Putting real values back into streamed text, whatever the cuts between chunks.

A chunk's end may be the beginning of a stand-in, so text that could still grow into one is held back; the rest goes out at
once.  As a stateful streaming query the state is the held text and a few characters of what went before.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.needles import Needles

LEFT = 16
# Two places where a stand-in is a name in code and not a value.
_NAME_INDEX = re.compile(r"(?:environ|getenv|process\.env|env)\s*[\[.]\s*['\"]?$")
_NAME_FIELD = re.compile(r"process\.env\.$")
_ACCESS = re.compile(r"[.\[]\s*$")


class Mocks:
    """A channel's stand-ins, made ready once: looked up by their first characters, so a text costs the same with many or few."""

    def __init__(self, mocks: dict[str, str], marker: str = ""):
        self.real = {m: r for m, r in mocks.items() if m}
        self.words = sorted({*self.real, marker} - {""})
        self.longest = max(map(len, self.words), default=0)
        self.first = re.compile("[" + re.escape("".join(sorted({w[0] for w in self.words}))) + "]") if self.words else None
        self.known = Needles(self.real) if self.real else None

    def _begins(self, tail: str) -> bool:
        """Whether `tail` is the beginning of a longer word."""
        at = bisect_left(self.words, tail)
        return any([w.startswith(tail) and w != tail for w in self.words[at : at + 2]])

    def hold_from(self, text: str) -> int:
        """From where `text` must wait: the longest tail that could still become a stand-in and isn't inside one that is taken,
        or else a stand-in at the very end, as what follows it decides whether it is a name."""
        if self.first is None:
            return len(text)
        taken = list(self.known.longest(text)) if self.known else []
        n = 0
        for m in self.first.finditer(text, max(0, len(text) - self.longest + 1)):
            at = m.start()
            while n < len(taken) and taken[n][1] <= at:
                n += 1
            if not (n < len(taken) and taken[n][0] < at) and self._begins(text[at:]):
                return at
        return taken[-1][0] if taken and taken[-1][1] == len(text) else len(text)

    def put_back(self, left: str, text: str, right: str = "") -> str:
        """`text` with stand-ins as real values, except at names; `left` and `right` are only looked at."""
        if self.known is None:
            return text
        out, at = [], 0
        for start, end in self.known.longest(text):
            before = (left[max(0, len(left) - LEFT) :] + text[max(0, start - LEFT) : start])[-LEFT:]
            after = text[end] if end < len(text) else right[:1]
            named = _NAME_INDEX.search(before) or _NAME_FIELD.search(before) or (_ACCESS.search(before) and after not in ("'", '"'))
            if not named:
                out += [text[at:start], self.real[text[start:end]]]
                at = end
        return "".join([*out, text[at:]]) if out else text


def put_back(left: str, text: str, mocks: dict[str, str], right: str = "") -> str:
    return Mocks(mocks).put_back(left, text, right)


class Rehydrator:
    """State and steps of one channel."""

    def __init__(self, mocks: Mocks | dict[str, str], pending: str = "", left: str = ""):
        self.mocks = mocks if isinstance(mocks, Mocks) else Mocks(mocks)
        self.pending, self.left = pending, left

    def push(self, chunk: str, final: bool = False) -> str:
        held, first = self.pending + chunk, self.mocks.first
        if first is None or not first.search(held):  # no stand-in, nor the beginning of one
            self.left, self.pending = (self.left + held)[-LEFT:], ""
            return held
        cut = len(held) if final else self.mocks.hold_from(held)
        if not cut:
            self.pending = held
            return ""
        out = self.mocks.put_back(self.left, held[:cut], held[cut:])
        self.left, self.pending = (self.left + held[:cut])[-LEFT:], held[cut:]
        return out


def after_mocks(chunks: DataFrame, mapping: DataFrame, *order: str) -> DataFrame:
    """`chunks` with a column mocks, dealt and sorted by stream and `order`.  A stream's stand-ins come once, in a row of their own
    before its chunks, whose mocks are null; a null stream has none."""
    pairs = mapping.where("stream_id is not null").groupBy("stream_id").agg(F.map_from_entries(F.collect_set(F.struct("mock", "real"))).alias("mocks"))
    rows = chunks.withColumn("mocks", F.lit(None).cast(pairs.schema["mocks"].dataType)).unionByName(pairs, allowMissingColumns=True)
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", F.col("mocks").isNull(), *order)


def rehydrate_chunks(chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Batch form.  `chunks` (stream_id, channel, seq, delta), `mapping` (stream_id, mock, real): (stream_id, channel, seq, out).

    Streams are dealt by id and sorted within their partition, so a task holds one channel's tail at a time; what is held at a
    channel's end comes as one more row.  A channel is one task's work, as each chunk's output depends on the one before.
    """
    rows = after_mocks(chunks.select("stream_id", "channel", "seq", "delta"), mapping, "channel", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, worker, last, mocks = None, Rehydrator({}), -1, {}
        for batch in batches:
            out: list[tuple] = []
            for stream, channel, seq, delta, pairs in zip(*(column.to_pylist() for column in batch.columns)):
                if pairs is not None:
                    mocks = {stream: dict(pairs)}
                    continue
                if (stream, channel) != now:
                    if now is not None and worker.pending:
                        out.append((*now, last + 1, worker.push("", final=True)))
                    now, worker = (stream, channel), Rehydrator(mocks.get(stream, {}))
                out.append((stream, channel, seq, worker.push(delta or "")))
                last = seq
            yield _chunk_batch(out)
        if now is not None and worker.pending:
            yield _chunk_batch([(*now, last + 1, worker.push("", final=True))])

    return rows.mapInArrow(run, "stream_id string, channel int, seq int, out string")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["stream_id", "channel", "seq", "out"])


def rehydrate_stream(chunks: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Streaming form.  `chunks` (stream_id, channel, seq, delta, is_final, mocks map): (stream_id, channel, seq, out).

    A channel that stays silent for `timeout_ms` is flushed as if it had ended.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mocks, pending, left, last = {}, "", "", -1
        if state.exists:
            pending, left, last, names, reals = state.get
            mocks = dict(zip(names, reals))
        if state.hasTimedOut:
            out = Rehydrator(mocks, pending, left).push("", final=True)
            state.remove()
            yield pd.DataFrame([(key[0], key[1], last + 1, out)], columns=["stream_id", "channel", "seq", "out"])
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        out, done, known = [], False, Mocks(mocks)
        for seq, delta, ends, more in zip(rows["seq"], rows["delta"], rows["is_final"], rows["mocks"]):
            new = {m: r for m, r in dict(more if more is not None else {}).items() if mocks.get(m) != r}
            if new:
                mocks |= new
                known = Mocks(mocks)
            worker = Rehydrator(known, pending, left)
            done, last = bool(ends), int(seq)
            out.append((key[0], key[1], last, worker.push(delta or "", done)))
            pending, left = worker.pending, worker.left
        if done:
            state.remove()
        else:
            state.update((pending, left, last, list(mocks), list(mocks.values())))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", "channel", "seq", "out"])

    rows = chunks.select("stream_id", "channel", "seq", "delta", "is_final", "mocks")
    return rows.groupBy("stream_id", "channel").applyInPandasWithState(run, "stream_id string, channel int, seq int, out string", "pending string, left string, last int, names array<string>, reals array<string>", "append", "ProcessingTimeTimeout")


def cut_into_chunks(df: DataFrame, key: str, text: str, size: str) -> DataFrame:
    """(stream_id, channel, seq, delta): texts cut every `size` characters, `size` being a column."""
    whole = F.col(text)
    each = F.regexp_extract_all(whole, F.concat(F.lit("(?s).{1,"), F.col(size).cast("int"), F.lit("}")), F.lit(0))  # in one pass over the text
    pieces = F.when((F.length(whole) > 0) & (F.col(size) > 0), each).otherwise(F.array(F.substring(whole, F.lit(1), F.col(size).cast("int"))))
    return df.select(F.col(key).cast("string").alias("stream_id"), F.lit(0).alias("channel"), F.posexplode(pieces).alias("seq", "delta"))

"""Real values put back into event streams of chat interfaces, by channel, whatever the cuts between chunks.

A stream is one ordered sequence of events.  Each format says which strings of an event are the next piece of a channel's text,
which are a whole text, and where a channel ends; a channel is a block, a choice, an item or a candidate.  A piece goes through
its channel's `Rehydrator`, which holds back what could still grow into a stand-in.  Where a channel ends, what is held joins the
event's last piece of that channel, or goes into an event of its own before it.  Only those strings change, at their places: every
other byte of an event stays, and events without such strings stay as they are.

Input: chunks of a stream's text cut anywhere, by number.  Events end at a blank line, with or without carriage returns.  Null
chunks are empty; what follows the last blank line is an event too; a null mapping changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.sources.jsonplaces import Arr, Obj, Text, added_item, added_name, literal, read_json, readable, spliced
from veilmark.streaming.rehydrate import Mocks, Rehydrator, after_mocks

_BLANK_LINE = re.compile(r"\r?\n\r?\n")
_DATA = re.compile(r"^data: ?((?:.*[^\r\n])?\r*?)(?=\r?$)", re.MULTILINE)
_DONE = "[DONE]"


@dataclass
class Piece:
    """A string of an event that is the next piece of a channel; an event that `may_go` is left out while its text is held."""

    channel: str
    text: Text
    may_go: bool = False


@dataclass
class Whole:
    """A string that is a whole text."""

    text: Text


@dataclass
class End:
    """A channel's end.  What is held joins a piece of this event, or goes by `join` into the event, or by `event` before it."""

    channel: str
    event: dict | None = None
    join: object = None  # from what is held to a change
    name: str = ""  # of the event that goes before


@dataclass
class Seen:
    """What an event has for its format."""

    steps: list[Piece | Whole | End] = field(default_factory=list)
    every_end: bool = False  # all channels end here


def _number(x, otherwise: int = 0) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) else otherwise


def _objects(x) -> Iterator[Obj]:
    return (y for y in (x if isinstance(x, Arr) else []) if isinstance(y, Obj))


# The names of events and fields in the four formats.
def _anthropic_delta(channel: str, text: str) -> dict:
    return {"type": "content_block_delta", "index": int(channel), "delta": {"type": "text_delta", "text": text}}


def _anthropic(event: Obj) -> Seen:
    kind, delta, channel = event.get("type"), event.get("delta"), str(_number(event.get("index")))
    if kind == "content_block_delta" and isinstance(delta, Obj) and delta.get("type") == "text_delta" and isinstance(delta.get("text"), Text):
        return Seen([Piece(channel, delta["text"], may_go=True)])
    return Seen(every_end=kind in ("content_block_start", "content_block_stop", "message_stop"))


def _openai_delta(channel: str, text: str) -> dict:
    return {"object": "chat.completion.chunk", "choices": [{"index": int(channel), "delta": {"content": text}, "finish_reason": None}]}


def _openai(event: Obj) -> Seen:
    seen = Seen()
    for choice in _objects(event.get("choices")) if event.get("object") == "chat.completion.chunk" else ():
        channel, delta = str(_number(choice.get("index"))), choice.get("delta")
        text = delta.get("content") if isinstance(delta, Obj) else None
        if isinstance(text, Text):
            seen.steps.append(Piece(channel, text))
        if choice.get("finish_reason") is not None:
            into = (lambda held, delta=delta: added_name(delta, "content", held)) if isinstance(delta, Obj) and "content" not in delta else None
            seen.steps.append(End(channel, join=into))
    return seen


RESPONSE_TEXTS = ("response.output_text", "response.refusal", "response.reasoning_summary_text")


def _responses_channel(event: Obj) -> str:
    part = next((event[n] for n in ("content_index", "summary_index", "output_index") if event.get(n) is not None), 0)
    return f"{event.get('item_id') or '?'}:{part}"


def _responses(event: Obj) -> Seen:
    kind, _, end = str(event.get("type") or "").rpartition(".")
    channel = _responses_channel(event)
    if kind in RESPONSE_TEXTS and end == "delta" and isinstance(event.get("delta"), Text):
        return Seen([Piece(channel, event["delta"])])
    if kind in RESPONSE_TEXTS and end == "done":
        told = {k: event[k] for k in ("item_id", "output_index", "content_index", "summary_index") if k in event}
        return Seen([End(channel, {"type": f"{kind}.delta", **told}, name=f"{kind}.delta"), *(Whole(event[n]) for n in ("text", "refusal") if isinstance(event.get(n), Text))])
    if kind == "response" and end in ("completed", "incomplete") and isinstance(event.get("response"), Obj):
        parts = [p for item in _objects(event["response"].get("output")) for p in _objects(item.get("content"))]
        return Seen([Whole(p[n]) for p in parts for n in ("text", "refusal") if isinstance(p.get(n), Text)])
    return Seen()


def _gemini_delta(channel: str, text: str) -> dict:
    return {"candidates": [{"index": int(channel), "content": {"role": "model", "parts": [{"text": text}]}}]}


def _gemini(event: Obj) -> Seen:
    seen = Seen()
    for candidate in _objects(event.get("candidates")):
        channel, content = str(_number(candidate.get("index"))), candidate.get("content")
        parts = content.get("parts") if isinstance(content, Obj) else None
        seen.steps += [Piece(channel, p["text"]) for p in _objects(parts) if isinstance(p.get("text"), Text)]
        if candidate.get("finishReason") is not None:
            into = None
            if isinstance(parts, Arr):
                into = lambda held, parts=parts: added_item(parts, {"text": held})
            elif isinstance(content, Obj) and "parts" not in content:
                into = lambda held, content=content: added_name(content, "parts", [{"text": held}])
            elif "content" not in candidate:
                into = lambda held, candidate=candidate: added_name(candidate, "content", {"parts": [{"text": held}]})
            seen.steps.append(End(channel, join=into))
    return seen


READERS = {"anthropic": _anthropic, "openai": _openai, "responses": _responses, "gemini": _gemini}


def _own_event(shape: str, channel: str, held: str, end: End | None) -> str:
    """An event that carries what a channel held."""
    if shape == "responses":
        body = {**(end.event if end and end.event else {"type": f"{RESPONSE_TEXTS[0]}.delta", "item_id": channel.rpartition(":")[0]}), "delta": held}
        return f"event: {body['type']}\ndata: {literal(body)}\n\n"
    made = {"anthropic": _anthropic_delta, "openai": _openai_delta, "gemini": _gemini_delta}[shape](channel, held)
    return ("event: content_block_delta\n" if shape == "anthropic" else "") + f"data: {literal(made)}\n\n"


class EventStream:
    """State and steps of one stream: the unfinished event and each channel's held text."""

    def __init__(self, shape: str, mocks: Mocks, rest: str = "", channels: dict[str, tuple[str, str]] | None = None):
        self.shape, self.mocks, self.rest = shape, mocks, rest
        self.channels = {c: Rehydrator(mocks, pending, left) for c, (pending, left) in (channels or {}).items()}

    def state(self) -> tuple[str, dict[str, tuple[str, str]]]:
        return self.rest, {c: (r.pending, r.left) for c, r in self.channels.items()}

    def feed(self, chunk: str, final: bool = False) -> str:
        """What goes out for a chunk.  An end of a chunk within a blank line waits for the next."""
        if "\n" not in chunk and not final:  # no blank line ends here
            self.rest += chunk
            return ""
        text, out, at = self.rest + chunk, [], 0
        for m in _BLANK_LINE.finditer(text, max(0, len(self.rest) - 3)):
            out.append(self._event(text[at : m.start()], m.group()))
            at = m.end()
        self.rest = text[at:]
        if final:
            if self.rest:
                out.append(self._event(self.rest, ""))
            out.append(self._held(None))
            self.rest, self.channels = "", {}
        return "".join(out)

    def _held(self, end: End | None) -> str:
        """Events for what all channels hold, which then start anew."""
        held = [(c, r.push("", final=True)) for c, r in self.channels.items()]
        self.channels = {}
        return "".join(_own_event(self.shape, c, text, end) for c, text in held if text)

    def _channel(self, name: str) -> Rehydrator:
        return self.channels.setdefault(name, Rehydrator(self.mocks))

    def _event(self, raw: str, end: str) -> str:
        lines = list(_DATA.finditer(raw))
        if not lines:
            return raw + end
        data = "\n".join(m.group(1) for m in lines)
        if data.strip() == _DONE:
            return self._held(None) + raw + end
        try:
            event = read_json(data)
        except ValueError:
            return raw + end
        seen = READERS[self.shape](event) if isinstance(event, Obj) else Seen()
        before, new, others, pieces, gone = "", {}, [], {}, False
        if seen.every_end:
            before = self._held(None)
        for step in seen.steps:
            if isinstance(step, Piece):
                out = self._channel(step.channel).push(step.text)
                new[step.text.start] = (step.text, out)
                pieces[step.channel] = step.text
                gone = step.may_go and not out
            elif isinstance(step, Whole):
                new[step.text.start] = (step.text, Rehydrator(self.mocks).push(step.text, final=True))
            else:
                worker = self.channels.pop(step.channel, None)
                if not worker or not (held := worker.push("", final=True)):
                    continue
                if step.channel in pieces:
                    text = pieces[step.channel]
                    new[text.start] = (text, new[text.start][1] + held)
                elif step.join:
                    others.append(step.join(held))
                else:
                    before += _own_event(self.shape, step.channel, held, step)
        if gone:
            return before
        changes = [(text.start, text.end, literal(to)) for text, to in new.values() if to != text] + others
        if not changes:
            return before + raw + end
        # the data lines give way to one with the new JSON; all other lines stay
        first, made = lines[0].start(), "data: " + spliced(data, changes)
        rest = [raw[lines[0].end() :]] if len(lines) == 1 else [line for line in raw[first:].split("\n") if not line.startswith("data:")]
        return before + raw[:first] + (made + rest[0] if len(lines) == 1 else "\n".join([made, *rest])) + end


def rehydrate_events(chunks: DataFrame, mapping: DataFrame, shape: str) -> DataFrame:
    """Batch form.  `chunks` (stream_id, seq, chunk), `mapping` (stream_id, mock, real): (stream_id, seq, out).

    Streams are dealt by id and sorted within their partition; what is held at a stream's end comes as one more row.  A stream is
    one task's work, as each chunk's output depends on the one before; a task holds one unfinished event and its channels' tails.
    """
    rows = after_mocks(chunks.select("stream_id", "seq", "chunk"), mapping, "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, worker, last, mocks = None, EventStream(shape, Mocks({})), -1, {}
        for batch in batches:
            out: list[tuple] = []
            for stream, seq, chunk, pairs in zip(*(column.to_pylist() for column in batch.columns)):
                if pairs is not None:
                    mocks = {stream: dict(pairs)}
                    continue
                if stream != now:
                    if now is not None and (tail := worker.feed("", final=True)):
                        out.append((now, last + 1, tail))
                    now, worker = stream, EventStream(shape, Mocks(mocks.get(stream, {})))
                out.append((stream, seq, readable(worker.feed(chunk or ""))))
                last = seq
            yield _batch(out)
        if now is not None and (tail := worker.feed("", final=True)):
            yield _batch([(now, last + 1, tail)])

    return rows.mapInArrow(run, "stream_id string, seq int, out string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.string()])], ["stream_id", "seq", "out"])


def rehydrate_event_stream(chunks: DataFrame, shape: str, timeout_ms: int = 60_000) -> DataFrame:
    """Streaming form.  `chunks` (stream_id, seq, chunk, is_final, mocks map): (stream_id, seq, out).

    The state is the unfinished event and the channels' tails.  Stand-ins may come with any chunk.  A stream that stays silent for
    `timeout_ms` is flushed as if it had ended.
    """
    columns = ["stream_id", "seq", "out"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest, channels, mocks, last = "", {}, {}, -1
        if state.exists:
            rest, held, known, last = state.get
            channels, mocks = {c: tuple(x) for c, x in json.loads(held).items()}, json.loads(known)
        if state.hasTimedOut:
            out = EventStream(shape, Mocks(mocks), rest, channels).feed("", final=True)
            state.remove()
            yield pd.DataFrame([(key[0], last + 1, out)], columns=columns)
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        worker, out, done = EventStream(shape, Mocks(mocks), rest, channels), [], False
        for seq, chunk, ends, more in zip(rows["seq"], rows["chunk"], rows["is_final"], rows["mocks"]):
            new = {m: r for m, r in dict(more if more is not None else {}).items() if mocks.get(m) != r}
            if new:
                mocks |= new
                worker = EventStream(shape, Mocks(mocks), *worker.state())
            done, last = bool(ends), int(seq)
            out.append((key[0], last, readable(worker.feed(chunk or "", done))))
        if done:
            state.remove()
        else:
            rest, channels = worker.state()
            state.update((rest, json.dumps(channels), json.dumps(mocks), last))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=columns)

    rows = chunks.select("stream_id", "seq", "chunk", "is_final", "mocks")
    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq int, out string", "rest string, channels string, mocks string, last int", "append", "ProcessingTimeTimeout")

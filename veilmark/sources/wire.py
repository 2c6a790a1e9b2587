"""Request bodies and event streams of chat interfaces as rows of text, and texts written back into bodies.

A body's texts are found by the places of its format; each comes with its path, by which a changed text is put back.  A body
none of whose texts changed stays the same string; names, ids and arguments of tools are never touched.  Bodies that aren't
JSON objects have no texts and stay as they are.

Changed texts are spliced into the body at their places, so every other byte, forms of numbers, order and repeated names
included, stays.  Halves of surrogate pairs come out as U+FFFD, and stay as they are in the body unless their text changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.batches import small_batches
from veilmark.sources.jsonplaces import Arr, Obj, Text, added_item, added_name, literal, read_json, readable, spliced

# Headers that a relay must not pass on.
REQUEST_HEADERS_DROPPED = ["host", "connection", "keep-alive", "proxy-connection", "transfer-encoding", "content-length", "accept-encoding"]
RESPONSE_HEADERS_DROPPED = ["connection", "keep-alive", "transfer-encoding", "content-length", "content-encoding"]

TEXT, TOOL = "text", "tool_result"
Place = tuple[str, tuple, str]  # kind; path; text
Seen = Iterator[Place]


def kept_headers(headers: Column, dropped: list[str]) -> Column:
    return F.map_filter(headers, lambda name, value: ~F.lower(name).isin(*dropped))


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _each(x) -> Iterator[tuple[int, dict]]:
    """The objects of a list, with their places; nothing if it is no list."""
    return ((i, y) for i, y in enumerate(x if isinstance(x, list) else []) if isinstance(y, dict))


def _content(kind: str, path: tuple, content, types: tuple[str, ...] = ("text",)) -> Seen:
    """A content that is a string, or a list of parts of these types (any type, if there are none)."""
    if isinstance(content, str):
        yield kind, path, content
    for i, part in _each(content):
        if isinstance(part.get("text"), str) and (not types or part.get("type") in types):
            yield kind, (*path, i, "text"), part["text"]


def _leaves(kind: str, path: tuple, value) -> Seen:
    """All strings in a JSON value at any depth, in order; names of fields are none."""
    waiting = [(path, value)]
    while waiting:
        at, x = waiting.pop()
        if isinstance(x, str):
            yield kind, at, x
        elif isinstance(x, (dict, list)):
            inner = x.items() if isinstance(x, dict) else enumerate(x)
            waiting.extend(reversed([((*at, name), y) for name, y in inner]))


def _anthropic(body: dict) -> Seen:
    yield from _content(TEXT, ("system",), body.get("system"))
    for n, message in _each(body.get("messages")):
        content = message.get("content")
        yield from _content(TEXT, ("messages", n, "content"), content)
        for i, block in _each(content):
            if block.get("type") == "tool_result":
                yield from _content(TOOL, ("messages", n, "content", i, "content"), block.get("content"))


def _openai(body: dict) -> Seen:
    for n, message in _each(body.get("messages")):
        yield from _content(TOOL if message.get("role") == "tool" else TEXT, ("messages", n, "content"), message.get("content"))


def _responses(body: dict) -> Seen:
    for name in ("instructions", "input"):
        if isinstance(body.get(name), str):
            yield TEXT, (name,), body[name]
    for n, item in _each(body.get("input")):
        if item.get("type") == "message" or item.get("type") is None and isinstance(item.get("role"), str):
            yield from _content(TEXT, ("input", n, "content"), item.get("content"), ("input_text", "output_text", "text"))
        elif item.get("type") == "function_call_output":
            yield from _content(TOOL, ("input", n, "output"), item.get("output"), ())


def _gemini(body: dict) -> Seen:
    for name in ("systemInstruction", "system_instruction"):
        yield from _content(TEXT, (name, "parts"), _parts(body.get(name)), ())
    for n, content in _each(body.get("contents")):
        yield from _content(TEXT, ("contents", n, "parts"), _parts(content), ())
        for i, part in _each(_parts(content)):
            response = _dict(part.get("functionResponse")).get("response")
            if isinstance(response, (dict, list)):
                yield from _leaves(TOOL, ("contents", n, "parts", i, "functionResponse", "response"), response)


def _parts(content) -> list | None:
    parts = _dict(content).get("parts")
    return parts if isinstance(parts, list) else None


FORMATS: dict[str, Callable[[dict], Seen]] = {"anthropic": _anthropic, "openai": _openai, "responses": _responses, "gemini": _gemini}


Change = tuple[int, int, str]


def _note_text(holder: Obj, name: str, note: str, part: dict, text: str | None = None) -> list[Change]:
    """Append `note` to a text (which is now `text`), `part` to a list; the note goes where nothing is; anything else stays."""
    held = holder.get(name)
    if held is None:  # a name with null is given once more, as the last one counts
        return [added_name(holder, name, note)]
    if isinstance(held, Text):
        return [(held.start, held.end, literal((held if text is None else text) + "\n\n" + note))]
    return [added_item(held, part)] if isinstance(held, Arr) else []


def directive_changes(shape: str, body: Obj, note: str, new: dict[int, str]) -> list[Change]:
    """What tells the model, where its format has such a text, to repeat stand-ins as they are.

    `new` has the changed texts by the places where they start, as a change of the same text must hold both.
    """
    part = {"type": "text", "text": note}
    known = lambda x: new.get(x.start) if isinstance(x, Text) else None
    if shape == "anthropic":
        return _note_text(body, "system", note, part, known(body.get("system")))
    if shape == "responses":
        held = body.get("instructions")
        return [] if isinstance(held, list) else _note_text(body, "instructions", note, {}, known(held))
    if shape == "openai" and isinstance(body.get("messages"), Arr):
        first = next((m for _, m in _each(body["messages"]) if m.get("role") in ("system", "developer")), None)
        if first is None:
            return [added_item(body["messages"], {"role": "system", "content": note}, first=True)]
        return _note_text(first, "content", note, part, known(first.get("content")))
    if shape == "gemini":
        name = "system_instruction" if "system_instruction" in body and "systemInstruction" not in body else "systemInstruction"
        held = body.get(name)
        if not isinstance(held, Obj):
            return [added_name(body, name, {"parts": [{"text": note}]})]
        if isinstance(held.get("parts"), Arr):
            return [added_item(held["parts"], {"text": note})]
        return [added_name(held, "parts", [{"text": note}])]
    return []


def body_object(body: str | None) -> Obj | None:
    """A body that is a JSON object."""
    try:
        value = read_json(body or "null")
    except ValueError:
        return None
    return value if isinstance(value, Obj) else None


def pointer(number: int, path: tuple) -> str:
    """The place of a text: its number in the body, so places sort as texts stand, and its path as a JSON pointer."""
    return f"{number:06d}:" + "".join("/" + str(x).replace("~", "~0").replace("/", "~1") for x in path)


def request_texts(df: DataFrame, key: str, body: str, shape: str) -> DataFrame:
    """(id, path, kind, text) of the texts in bodies of one of FORMATS; kind is text or tool_result."""
    find = FORMATS[shape]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            found: list[tuple[str, str, str]] = []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for number, (kind, path, text) in enumerate(find(body_object(raw) or {})):
                    take.append(i)
                    found.append((pointer(number, path), kind, readable(text)))
            columns = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], ["id", "path", "kind", "text"])

    kind = df.schema[key].dataType.simpleString()
    return small_batches(df).select(F.col(key).alias("id"), F.col(body).alias("body")).mapInArrow(read, f"id {kind}, path string, kind string, text string")


def rewritten(shape: str, raw: str, body: Obj, wanted: dict[str, str], directive: str | None = None) -> str:
    """`raw`, read as `body`, with the texts at the pointers of `wanted`, and the `directive` where one of them is new."""
    new = {}
    for number, (_, path, text) in enumerate(FORMATS[shape](body)):
        to = wanted.get(pointer(number, path))
        if to is not None and to != readable(text):
            new[text.start] = (text.start, text.end, to)
    if not new:
        return raw
    noted = directive_changes(shape, body, directive, {at: to for at, (_, _, to) in new.items()}) if directive else []
    both = {start: (start, end, literal(to)) for start, end, to in new.values()}
    for change in noted:  # a note on a text that is new replaces it with both
        if change[0] != change[1]:
            both.pop(change[0], None)
    return spliced(raw, [*both.values(), *noted])


def written_back(df: DataFrame, key: str, body: str, shape: str, texts: DataFrame, directive: str | None = None) -> DataFrame:
    """(id, body) with the changed texts of `texts` (id, path, text), and the `directive` where one has changed; `key` is unique."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                value = body_object(raw) if changes else None
                wanted = {c["path"]: c["text"] for c in changes or []}
                out.append(raw if value is None else rewritten(shape, raw, value, wanted, directive))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "body"])

    kind = df.schema[key].dataType.simpleString()
    changes = texts.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("path", "text")).alias("changes"))  # of one body
    rows = df.select(F.col(key).alias("id"), F.col(body).alias("body")).join(changes, F.col("id") == F.col("of"), "left")
    return small_batches(rows).select("id", "body", "changes").mapInArrow(write, f"id {kind}, body string")


#: The endings of request paths and their formats.
ROUTES = {"/v1/messages": "anthropic", "/v1/chat/completions": "openai", "/v1/responses": "responses", ":generateContent": "gemini", ":streamGenerateContent": "gemini"}


def format_of(path: Column) -> Column:
    """The format of a request by its path, without what follows a question mark; null where there is none."""
    plain = F.regexp_replace(path, r"\?.*$", "")
    return F.coalesce(*[F.when(plain.endswith(end), F.lit(shape)) for end, shape in ROUTES.items()])


def sse_events(df: DataFrame, key: str, body: str) -> DataFrame:
    """(id, seq, event, data): events end at a blank line, with or without carriage returns; data lines are joined."""
    events = df.select(F.col(key).alias("id"), F.posexplode(F.split(F.col(body), "\r?\n\r?\n")).alias("seq", "raw")).where("trim(raw) <> ''")
    lines = F.split("raw", "\r?\n")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", ""))
    name = F.filter(lines, lambda x: x.startswith("event:"))
    return events.select("id", "seq", F.regexp_replace(F.try_element_at(name, F.lit(1)), "^event: ?", "").alias("event"), F.array_join(data, "\n").alias("data"))

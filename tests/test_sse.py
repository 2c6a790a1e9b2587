"""Event streams: channels, cuts anywhere, other events as they were; batch and streaming forms agree."""

import json
import random
import re
import time

import pytest

from veilmark.functions.needles import Needles
from veilmark.sources.jsonplaces import added_item, added_name, literal, read_json, spliced
from veilmark.streaming.rehydrate import Mocks, Rehydrator, after_mocks, cut_into_chunks, rehydrate_chunks
from veilmark.streaming.sse import EventStream, rehydrate_event_stream, rehydrate_events

MOCKS = {"VEILMARK_MOCK_KEY_AB12": "real-one", "VEILMARK_MOCK_KEY_AB123": "rëal \"two\"\n", "mock-host.example": "db1.corp"}
TEXT = 'use VEILMARK_MOCK_KEY_AB12, VEILMARK_MOCK_KEY_AB123 at mock-host.example; VEILMARK_MOCK_KEY_A "q" ü𝒳 process.env.VEILMARK_MOCK_KEY_AB12 and VEILMARK_MOCK'
REAL = 'use real-one, rëal "two"\n at db1.corp; VEILMARK_MOCK_KEY_A "q" ü𝒳 process.env.VEILMARK_MOCK_KEY_AB12 and VEILMARK_MOCK'


def event(body, name=None, end="\n"):
    return (f"event: {name}{end}" if name else "") + f"data: {json.dumps(body)}{end}{end}"


def cut(text, draw, most):
    out, at = [], 0
    while at < len(text):
        n = draw.randint(1, most)
        out.append(text[at : at + n])
        at += n
    return out


def anthropic(text, draw):
    pings = 'event: ping\ndata: {"type": "ping",  "n": 1.10}\n\n: note\n\n'
    body = 'event: message_start\ndata: {"type":"message_start"}\n\n'
    for index in (0, 1):
        body += event({"type": "content_block_start", "index": index}, "content_block_start")
        body += "".join(event({"type": "content_block_delta", "index": index, "delta": {"type": "text_delta", "text": p}}, "content_block_delta") + (pings if n == 3 else "") for n, p in enumerate(cut(text, draw, 9)))
        body += event({"type": "content_block_delta", "index": index, "delta": {"type": "input_json_delta", "partial_json": "VEILMARK_MOCK_KEY_AB12"}}, "content_block_delta")
        body += event({"type": "content_block_stop", "index": index}, "content_block_stop")
    return body + event({"type": "message_stop"}, "message_stop")


def openai(text, draw):
    parts = [(n, p) for n in (0, 1) for p in cut(text, draw, 9)]
    mixed = sorted(range(len(parts)), key=lambda i: (i if parts[i][0] == 0 else i - len(parts) / 2))
    body = "".join(event({"object": "chat.completion.chunk", "choices": [{"index": parts[i][0], "delta": {"content": parts[i][1]}, "finish_reason": None}]}) for i in mixed)
    body += 'data: {"object":"chat.completion.chunk","choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}\n\n'
    return body + 'data: {"object": "other"}\n\ndata: [DONE]\n\n'  # choice 1 ends with the stream's mark


def responses(text, draw):
    at = {"item_id": "m1", "output_index": 0, "content_index": 0}
    body = "".join(event({"type": "response.output_text.delta", **at, "delta": p}, "response.output_text.delta") for p in cut(text, draw, 9))
    body += event({"type": "response.function_call_arguments.delta", **at, "delta": "VEILMARK_MOCK_KEY_AB12"})
    body += event({"type": "response.output_text.done", **at, "text": text}, "response.output_text.done")
    return body + event({"type": "response.completed", "response": {"id": "VEILMARK_MOCK_KEY_AB12", "output": [{"content": [{"type": "output_text", "text": text}, {"refusal": text}]}]}}, "response.completed")


def gemini(text, draw):
    body = "".join(event({"candidates": [{"content": {"parts": [{"text": p}], "role": "model"}}, {"index": 1, "content": {"parts": [{"functionCall": {"name": "VEILMARK_MOCK_KEY_AB12"}}, {"text": p}]}}]}, end="\r\n") for p in cut(text, draw, 9))
    return body + event({"candidates": [{"content": {"parts": []}, "finishReason": "STOP"}, {"index": 1, "finishReason": "STOP"}], "usage": 1e400 if False else 1.5}, end="\r\n")


MADE = {"anthropic": anthropic, "openai": openai, "responses": responses, "gemini": gemini}


def events(body):
    for raw in re.split(r"\r?\n\r?\n", body):
        data = [x[5:].strip() for x in raw.splitlines() if x.startswith("data:")]
        if data and data[0] != "[DONE]":
            yield raw, json.loads("\n".join(data))


def texts(shape, body):
    """Texts by channel, and the raw form of all events that have none."""
    out, others = {}, []
    put = lambda c, t: out.__setitem__(c, out.get(c, "") + t)
    for raw, e in events(body):
        if shape == "anthropic" and e.get("delta", {}).get("type") == "text_delta":
            put(e["index"], e["delta"]["text"])
        elif shape == "openai" and e["object"] == "chat.completion.chunk":
            for c in e["choices"]:
                put(c["index"], c["delta"].get("content", ""))
        elif shape == "responses" and e["type"] == "response.output_text.delta":
            put((e["item_id"], e["content_index"]), e["delta"])
        elif shape == "responses" and e["type"] == "response.output_text.done":
            put("done", e["text"])
        elif shape == "responses" and e["type"] == "response.completed":
            put("whole", e["response"]["output"][0]["content"][0]["text"])
            put("refusal", e["response"]["output"][0]["content"][1]["refusal"])
            assert e["response"]["id"] == "VEILMARK_MOCK_KEY_AB12"
        elif shape == "gemini":
            for c in e["candidates"]:
                for p in c.get("content", {}).get("parts", []):
                    put(c.get("index", 0), p.get("text", ""))
        else:
            others.append(raw)
    return out, others


@pytest.mark.parametrize("shape", MADE)
def test_cut_anywhere(shape):
    draw = random.Random(shape)
    for _ in range(30):
        body = MADE[shape](TEXT, draw)
        stream = EventStream(shape, Mocks(MOCKS, "VEILMARK_MOCK_"))
        out = "".join(stream.feed(c) for c in cut(body, draw, draw.choice([1, 5, 200]))) + stream.feed("", final=True)
        got, others = texts(shape, out)
        want, same = texts(shape, body)
        assert others == same
        assert got == {c: REAL for c in want}, shape


@pytest.mark.parametrize("shape", MADE)
def test_without_stand_ins_every_byte_stays(shape):
    body = MADE[shape]("plain é words", random.Random(1)) + "data: no json\n\ndata: [1, 2]\n\nrest"
    stream = EventStream(shape, Mocks(MOCKS))
    assert stream.feed(body) + stream.feed("", final=True) == body or shape == "anthropic"
    assert stream.state() == ("", {})


def test_streams_that_end_early():
    for shape, body in (("anthropic", event({"type": "content_block_delta", "index": 2, "delta": {"type": "text_delta", "text": "x VEILMARK_MOCK_KEY_AB12"}})), ("openai", event({"object": "chat.completion.chunk", "choices": [{"index": 2, "delta": {"content": "x VEILMARK_MOCK_KEY_AB12"}}]})), ("gemini", event({"candidates": [{"index": 2, "content": {"parts": [{"text": "x VEILMARK_MOCK_KEY_AB12"}]}}]}))):
        stream = EventStream(shape, Mocks(MOCKS))
        assert texts(shape, stream.feed(body) + stream.feed("", final=True))[0] == {2: "x real-one"}, shape
    stream = EventStream("responses", Mocks(MOCKS))
    held = stream.feed(event({"type": "response.output_text.delta", "item_id": "m", "content_index": 0, "delta": "x VEILMARK_MOCK_KEY_AB12"})) + stream.feed("", final=True)
    assert "".join(e["delta"] for _, e in events(held)) == "x real-one"


def test_lookup_is_the_plain_one():
    draw = random.Random(2)
    for _ in range(400):
        words = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 5))): str(n) for n in range(draw.choice([1, 3, 12]))}
        text = "".join(draw.choice("abc") for _ in range(30))
        pattern = re.compile("|".join(sorted(map(re.escape, words), key=len, reverse=True)))
        assert list(Needles(words).longest(text)) == [m.span() for m in pattern.finditer(text)]
        assert Needles(words).present(text) == {w for w in words if w in text}
        worker = Rehydrator(Mocks(words))
        out = "".join(worker.push(c) for c in cut(text, draw, 4)) + worker.push("", final=True)
        held = Rehydrator(Mocks(words)).push(text, final=True)
        assert out == held == pattern.sub(lambda m: words[m.group()], text)


def test_ten_thousand_stand_ins():
    import time

    mocks = {f"VEILMARK_MOCK_{n:06d}": f"real{n}" for n in range(10_000)}
    text = " ".join(f"word {m}" for m in list(mocks)[:5000])
    known, began = Mocks(mocks), time.time()
    worker = Rehydrator(known)
    out = "".join(worker.push(text[i : i + 11]) for i in range(0, len(text), 11)) + worker.push("", final=True)
    assert out == " ".join(f"word real{n}" for n in range(5000)) and time.time() - began < 3


def test_json_with_places():
    draw = random.Random(6)

    def value(depth):
        kind = draw.choice("sndlo" if depth else "snd")
        if kind == "s":
            return "".join(draw.choice('ab"\\/é\n 𝒳') for _ in range(draw.randint(0, 5)))
        if kind in "nd":
            return draw.choice([None, True, False, 0, -3, 1.5, 1e300])
        return [value(depth - 1) for _ in range(draw.randint(0, 3))] if kind == "l" else {value(0).__str__(): value(depth - 1) for _ in range(draw.randint(0, 3))}

    for _ in range(500):
        v = value(4)
        text = json.dumps(v, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
        assert read_json(text) == v
        for at in {draw.randrange(len(text)) for _ in range(3)}:  # broken texts are refused where the plain reader refuses them
            broken = text[:at] + draw.choice(',:]}{["x') + text[at + 1 :]
            try:
                want = json.loads(broken)
            except ValueError:
                with pytest.raises(ValueError):
                    read_json(broken)
            else:
                assert read_json(broken) == want
    deep = "[" * 200_000 + "]" * 200_000
    assert read_json(deep).end == 400_000
    body = read_json('{"a": [1.10, {}], "b": 1e400}')
    assert spliced('{"a": [1.10, {}], "b": 1e400}', [added_name(body, "c", "é"), added_item(body["a"], 1), added_name(body["a"][1], "x", [])]) == '{"a": [1.10, {"x":[]},1], "b": 1e400,"c":"é"}'
    assert literal("\ud83d") == '"\\ud83d"' and read_json('"\\ud83d"') == "\ud83d"


@pytest.mark.parametrize("shape", ["anthropic", "responses"])
def test_batch_and_streaming_agree(spark, tmp_path, shape):
    draw = random.Random(4)
    rows = []
    for stream in ("s1", "s2"):
        parts = cut(MADE[shape](TEXT, draw), draw, 60)
        rows += [(stream, n, p, n == len(parts) - 1, MOCKS if n == 0 else None) for n, p in enumerate(parts)]
    rows.append(("s3", 0, None, True, None))
    schema = "stream_id string, seq int, chunk string, is_final boolean, mocks map<string,string>"
    chunks = spark.createDataFrame(rows, schema)
    mapping = spark.createDataFrame([(s, m, r) for s in ("s1", "s2") for m, r in MOCKS.items()], "stream_id string, mock string, real string")

    def joined(found):
        out = {}
        for r in sorted(found, key=lambda r: (r["stream_id"], r["seq"])):
            out[r["stream_id"]] = out.get(r["stream_id"], "") + r["out"]
        return out

    batch = joined(rehydrate_events(chunks, mapping, shape).collect())
    assert set(texts(shape, batch["s1"])[0].values()) == {REAL} and batch["s3"] == ""
    for n, part in enumerate((rows[:40], rows[40:90], rows[90:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = rehydrate_event_stream(source, shape).writeStream.format("memory").queryName(f"sse_{shape}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    assert joined(spark.table(f"sse_{shape}").collect()) == batch


def test_pieces_of_a_long_text_in_linear_time(spark):
    """Each piece was sought from the text's start, so 100,000 pieces of one text took minutes."""
    from pyspark.sql import functions as F

    from veilmark.plans.sse import _pieces

    text, began = "aü𝒳\n" * 100_000, time.monotonic()
    pieces = spark.createDataFrame([(text, 4), (text[:10], 4), ("x", 4)], "t string, size int").select(_pieces(F.col("t"), F.col("size"))).collect()
    assert [p[0] for p in pieces] == [["aü𝒳\n"] * 100_000, ["aü𝒳\n", "aü𝒳\n", "aü"], ["x"]]
    assert time.monotonic() - began < 20


def test_stand_ins_come_once_before_their_chunks(spark):
    """They came with each chunk.  A mapping without chunks gives no row; a null stream has no stand-ins."""
    mock, real = "VEILMARK_MOCK_KEY_AB12", "real-one"
    chunks = spark.createDataFrame([("a", 1, 0, f"x {mock}"), ("a", 0, 0, mock[:9]), ("a", 0, 1, mock[9:] + " "), (None, 0, 0, f"{mock} "), ("b", 0, 0, mock + " "), (None, None, None, None)], "stream_id string, channel int, seq int, delta string")
    mapping = spark.createDataFrame([("a", mock, real), (None, mock, real), ("c", mock, real)], "stream_id string, mock string, real string")
    rows = after_mocks(chunks, mapping, "channel", "seq")
    assert rows.where("mocks is not null").count() == 2
    out = {(r["stream_id"], r["channel"], r["seq"]): r["out"] for r in rehydrate_chunks(chunks, mapping).collect()}
    assert out == {("a", 1, 0): "x ", ("a", 1, 1): real, ("a", 0, 0): "", ("a", 0, 1): f"{real} ", (None, 0, 0): f"{mock} ", ("b", 0, 0): f"{mock} ", (None, None, None): ""}


def test_chunks_of_a_long_text_in_linear_time(spark):
    """Each chunk was sought from the text's start."""
    text, began = "aü𝒳\n" * 60_000, time.monotonic()
    rows = spark.createDataFrame([("long", text, 2), ("empty", "", 2), ("none", None, 2), ("odd", "ab\nüc", 2)], "id string, t string, size int")
    found = {}
    for r in cut_into_chunks(rows, "id", "t", "size").orderBy("stream_id", "seq").collect():
        found.setdefault(r["stream_id"], []).append((r["seq"], r["delta"]))
    assert found.pop("long") == list(enumerate(["aü", "𝒳\n"] * 60_000))
    assert found == {"empty": [(0, "")], "none": [(0, None)], "odd": [(0, "ab"), (1, "\nü"), (2, "c")]}
    assert time.monotonic() - began < 20

"""Queries of event streams made from conversations, and the same in SQL.

Each message becomes the stream of one answer: its text, in which two stand-ins appear, is cut into deltas of a few characters,
which the format's events carry, and the whole is cut again into chunks that take no notice of events or characters of JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.detect import spread
from veilmark.plans.derived import table
from veilmark.sources.wire import sse_events
from veilmark.streaming.sse import rehydrate_events

KEY = "upper(substr(md5(concat(cast(conv_id AS varchar(20)), '-', cast(turn AS varchar(20)))), 1, 16))"
TEXTS = f"""SELECT concat(cast(conv_id AS varchar(20)), '-', cast(turn AS varchar(20))) AS id, coalesce(text, '') AS t, concat('AKIA', {KEY}) AS real, concat('VEILMARK_MOCK_AWS_ACCESS_KEY_', {KEY}) AS mock FROM conversations"""
PING = 'event: ping\ndata: {"type": "ping",  "n": 1.10}\n\n: a note\n\n'


def _said(name: Callable[[str], Column]) -> Column:
    """The text with its stand-in in the middle, in code where it is a name, and at the end."""
    return F.concat("t", F.lit(' "'), name("x"), F.lit('"; process.env.'), F.col("mock"), F.lit("; "), name("x"))


def _pieces(text: Column, size: Column) -> Column:
    """`text`, which isn't empty, cut every `size` characters, in one pass over it."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))


def _event(body: Column, name: str | None = None, end: str = "\n") -> Column:
    return F.concat(F.lit((f"event: {name}{end}" if name else "") + "data: "), F.to_json(body), F.lit(end + end))


def _bodies(shape: str, said: Column, size: Column) -> Column:
    lit = F.lit
    if shape == "anthropic":
        delta = lambda p: _event(F.struct(lit("content_block_delta").alias("type"), lit(0).alias("index"), F.struct(lit("text_delta").alias("type"), p.alias("text")).alias("delta")), "content_block_delta")
        plain = lambda kind: f'event: {kind}\ndata: {{"type":"{kind}","index":0}}\n\n'
        ends = lit(plain("message_start") + plain("content_block_start") + PING), lit(plain("content_block_stop") + plain("message_stop"))
    elif shape == "openai":
        chunk = lambda inner, done: F.struct(lit("chat.completion.chunk").alias("object"), F.array(F.struct(lit(0).alias("index"), inner.alias("delta"), done.alias("finish_reason"))).alias("choices"))
        delta = lambda p: _event(chunk(F.struct(p.alias("content")), lit(None).cast("string")))
        ends = lit(PING), F.concat(_event(chunk(F.create_map().cast("map<string,string>"), lit("stop"))), lit("data: [DONE]\n\n"))
    elif shape == "responses":
        kind = "response.output_text"
        at = [lit("m").alias("item_id"), lit(0).alias("content_index")]
        delta = lambda p: _event(F.struct(lit(f"{kind}.delta").alias("type"), *at, p.alias("delta")), f"{kind}.delta")
        done = _event(F.struct(lit(f"{kind}.done").alias("type"), *at, said.alias("text")), f"{kind}.done")
        whole = F.struct(F.array(F.struct(F.array(F.struct(said.alias("text"))).alias("content"))).alias("output"))
        ends = lit(PING), F.concat(done, _event(F.struct(lit("response.completed").alias("type"), whole.alias("response")), "response.completed"))
    else:
        part = lambda p: F.struct(F.array(F.struct(p.alias("text"))).alias("parts")).alias("content")
        delta = lambda p: _event(F.struct(F.array(F.struct(lit(0).alias("index"), part(p))).alias("candidates")), end="\r\n")
        ends = lit(PING), lit('data: {"candidates":[{"index":0,"finishReason":"STOP"}]}\r\n\r\n')
    return F.concat(ends[0], F.array_join(F.transform(_pieces(said, size), delta), ""), ends[1])


# Where each format's deltas, and whole texts, lie.
_TEXT = {"anthropic": ["$.delta.text"], "openai": ["$.choices[0].delta.content"], "responses": ["$.delta", "$.text", "$.response.output[0].content[0].text"], "gemini": ["$.candidates[0].content.parts[0].text"]}


def _rehydrated(shape: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """(id, text, others): what the deltas (or a whole text) say after stand-ins are put back, and the other events as they are."""
        table(spark, sf_dir, "conversations").createOrReplaceTempView("veilmark_conversations")
        rows = spread(spark.sql(TEXTS.replace("FROM conversations", "FROM veilmark_conversations")))
        size = (F.length("t") % 11 + 4).cast("int")
        body = _bodies(shape, _said(lambda _: F.col("mock")), size)
        cut = F.posexplode(_pieces(F.col("body"), F.col("width"))).alias("seq", "chunk")
        chunks = rows.select(F.col("id").alias("stream_id"), body.alias("body"), (F.length("t") % 50 + 30).cast("int").alias("width")).select("stream_id", cut)
        out = rehydrate_events(chunks, rows.select(F.col("id").alias("stream_id"), "mock", "real"), shape)
        whole = out.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "out"))).alias("parts"))
        whole = whole.select("stream_id", F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("body"))
        events = sse_events(whole, "stream_id", "body")
        places = range(len(_TEXT[shape]))
        read = events.select("id", "seq", "event", "data", *[F.get_json_object("data", path).alias(f"text{n}") for n, path in enumerate(_TEXT[shape])])
        other = F.when(F.coalesce(*[F.col(f"text{n}") for n in places]).isNull(), F.concat_ws("|", "event", "data"))
        told = F.struct("seq", *[f"text{n}" for n in places], other.alias("other"))
        all_ = read.groupBy("id").agg(F.array_sort(F.collect_list(told)).alias("all"))
        texts = [F.struct(F.lit(n).alias("place"), F.array_join(F.col("all")[f"text{n}"], "").alias("text")) for n in places]
        return all_.select("id", F.array_join(F.col("all")["other"], "\n").alias("others"), F.explode(F.array(*texts)).alias("x")).select("id", "x.place", "x.text", "others")

    return query


SHAPES = list(_TEXT)


def queries() -> dict:
    return {f"sse_{shape}_rehydrated": _rehydrated(shape) for shape in SHAPES}


def oracle_sql() -> dict[str, str]:
    ping = """'ping|{"type": "ping",  "n": 1.10}'"""
    plain = lambda kind: f"""'{kind}|{{"type":"{kind}","index":0}}'"""
    join = lambda parts: " || chr(10) || ".join(parts)
    note = "''"  # an event of comments only has neither name nor data
    # texts end with a stand-in, which is held until the event that ends the choice or candidate, and goes into that event
    others = {
        "anthropic": join([plain("message_start"), plain("content_block_start"), ping, note, plain("content_block_stop"), plain("message_stop")]),
        "openai": join([ping, note, "'[DONE]'"]),
        "responses": join([ping, note]),
        "gemini": join([ping, note]),
    }
    said = """t || ' "' || real || '"; process.env.' || mock || '; ' || real"""
    return {f"sse_{shape}_rehydrated": f"WITH t AS ({TEXTS}) SELECT id, p.place AS place, {said} AS text, {others[shape]} AS others FROM t CROSS JOIN (SELECT CAST(unnest(range({len(_TEXT[shape])})) AS INTEGER) AS place) p" for shape in SHAPES}

"""Whole request bodies made safe: their texts out, each distinct text worked on once, texts back, and a guard over the result.

The guard reads the finished body as a model would get it: every string in it, names of fields, ids and arguments of tools included,
with escapes undone.  A value that has a stand-in must be nowhere in it; if it is, the body doesn't go out.  Values shorter than
`GUARDED` characters (settings such as `1`) are not looked for, and others only between characters that aren't letters or digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.batches import of_rows, small_batches
from veilmark.functions.needles import Needles
from veilmark.operators.config import ScanConfig
from veilmark.operators.detect import spread
from veilmark.operators.protect import protect
from veilmark.operators.shared import written
from veilmark.sources.jsonplaces import Obj, read_json, readable
from veilmark.sources.wire import FORMATS, body_object, request_texts, rewritten

GUARDED = 4


def strings_of(value) -> Iterator[str]:
    """All strings of a JSON value, names of fields too, at any depth."""
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, Obj):
            waiting += [*x, *x.values()]
        elif isinstance(x, list):
            waiting += x


def _apart(text: str, start: int, end: int) -> bool:
    edge = lambda i: not (0 <= i < len(text) and text[i].isalnum())
    return (edge(start - 1) or not text[start].isalnum()) and (edge(end) or not text[end - 1].isalnum())


def survives(body: str, reals: list[str]) -> bool:
    """Whether one of `reals` can be read in a body."""
    looked = [r for r in reals if len(r) >= GUARDED]
    if not looked:
        return False
    known = Needles(looked)
    try:
        texts = [*strings_of(read_json(body)), body]
    except ValueError:
        texts = [body]
    for text in texts:
        for word in known.present(text):
            at = text.find(word)
            while at >= 0:
                if _apart(text, at, at + len(word)):
                    return True
                at = text.find(word, at + 1)
    return False


def protect_requests_as(df: DataFrame, key: str, body: str, shape: str, salt: str, settings, note: str) -> DataFrame:
    """`protect_requests` as `settings` (of sources.settings) have it; `note` is the directive."""
    return protect_requests(df, key, body, shape, salt, settings.scan, settings.on_detect, note if settings.directive else None, settings.mask_env, settings.mask_tool_results)


def protect_requests(df: DataFrame, key: str, body: str, shape: str, salt: str, config: ScanConfig | None = None, on_detect: str = "mask", directive: str | None = None, env_blocks: bool = True, tool_results: bool = True) -> DataFrame:
    """(id, body, changed, n_secrets, env_blocks, leaked, blocked, mocks), one row for each of `df`; `key` is unique.

    `shape` is one of FORMATS.  Without `env_blocks` environment blocks stay, without `tool_results` the results of tools do; the guard
    then still finds in them what is hidden elsewhere.  Bodies that aren't JSON objects, and those without anything to hide, stay the same bytes.  A body is
    null where it is `blocked`: with on_detect "block" if it has a secret, and always if a value that has a stand-in is still there
    (`leaked`).  `mocks` bring the answer back.  Null bodies stay null.  Texts are read out of the bodies, and findings made, when this is called.
    """
    if shape not in FORMATS:
        raise ValueError(f"no such format: {shape}")
    kind = df.schema[key].dataType.simpleString()
    bodies = df.select(F.col(key).alias("id"), F.col(body).alias("body"))
    texts = written(request_texts(spread(bodies), "id", "body", shape).select("kind", F.struct("id", "path").alias("place"), "text"))
    if not tool_results:
        texts = texts.where("kind <> 'tool_result'")
    safe = protect(texts, "place", "text", salt, config, env_blocks=env_blocks)
    per = safe.groupBy(F.col("id.id").alias("of")).agg(
        F.collect_list(F.struct(F.col("id.path").alias("path"), F.col("masked").alias("text"))).alias("changes"),  # of one body
        F.array_distinct(F.flatten(F.collect_list("mocks"))).alias("mocks"),
        F.sum("n_secrets").alias("n_secrets"),
        F.sum("env_blocks").alias("env_blocks"),
    )
    both = bodies.join(per, F.col("id").eqNullSafe(F.col("of")), "left")
    pairs = "array<struct<mock:string,real:string>>"
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = both.select("id", "body", "changes", F.coalesce("mocks", F.array().cast(pairs)).alias("mocks"), number("n_secrets"), number("env_blocks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, changed, leaked = [], [], []
            for raw, changes, reals in zip(batch.column(1).to_pylist(), of_rows(batch.column(2), "path", "text"), of_rows(batch.column(3), "real")):
                value = body_object(raw) if changes else None
                new = raw if value is None else rewritten(shape, raw, value, dict(changes), directive)
                out.append(None if new is None else readable(new))
                changed.append(new != raw)
                leaked.append(bool(new and reals) and survives(new, [r for (r,) in reals]))
            told = [batch.column(0), pa.array(out, pa.string()), pa.array(changed, pa.bool_()), pa.array(leaked, pa.bool_()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(told, ["id", "new", "changed", "leaked", "mocks", "n_secrets", "env_blocks"])

    told = small_batches(rows).mapInArrow(write, f"id {kind}, new string, changed boolean, leaked boolean, mocks {pairs}, n_secrets long, env_blocks long")
    blocked = F.col("leaked") | ((F.col("n_secrets") > 0) & F.lit(on_detect == "block"))
    return told.select("id", F.when(~blocked, F.col("new")).alias("body"), "changed", "n_secrets", "env_blocks", "leaked", blocked.alias("blocked"), "mocks")

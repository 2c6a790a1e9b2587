"""Environment files: telling them from code, and masking their values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.text import bound
from veilmark.operators.config import ScanConfig
from veilmark.operators.transform import mock_for

# An assignment's start, and what marks a line as code.
_ASSIGN = r"^\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*="
_CODE = r"[{}();]\s*$|=>|\b(function|return|class|import|require|if|for|while|switch|const|let|var)\b\s*[\w({]"


def looks_like_env(text: Column) -> Column:
    """Two assignments or more, no code, few of them closed by `;`, and hardly anything else."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & ~F.trim(x).rlike(r"^\[.*\]$"))
    assigned = F.filter(lines, lambda x: x.rlike(_ASSIGN))
    code = F.filter(lines, lambda x: ~x.rlike(_ASSIGN) & F.trim(x).rlike(_CODE))
    closed = F.filter(assigned, lambda x: F.regexp_replace(x, _ASSIGN, "").rlike(r";\s*$"))
    n = F.size(assigned)
    return F.coalesce((n >= 2) & (F.size(code) == 0) & (F.size(closed) < n * 0.5) & (n >= F.size(lines) * 0.7), F.lit(False))


# Fixed value: a fenced block; the group is what stands between the fences.  An opening fence that nothing closes takes all that
# follows it, as no later one can be closed either; else each of very many would look through the rest of the text.
FENCE = r"```[^\n]*+(?:\n([\s\S]*?)```|[\s\S]*+)"


def is_block(fence: Column) -> Column:
    """Whether what FENCE took is closed."""
    return F.contains(F.regexp_extract(fence, r"^[^\n]*\n([\s\S]*)", 1), F.lit("```"))


# An assignment with a value, on a line of its own: its head, then a quoted value (over lines if need be; it ends at a quote with
# an even number of backslashes before it) and the rest of the line, or a bare value and the rest of the line, comment included.
# No group is repeated that has no fixed length, so neither time nor stack grows with a long value.
VALUE = (
    r"(?<![^\n])([^\S\n]*+(?:export[^\S\n]+)?[A-Za-z_][A-Za-z0-9_]*[^\S\n]*+=[ \t]*+)"
    r"(?:\"(?!\")([\s\S]*?(?<!\\)(?:\\\\)*+)\"([^\n]*)|'([^']+)'([^\n]*)|([^\s'\"][^\n]*))"
)
# A comment begins after one white space; without a comment, white space at the end isn't part of a value.
COMMENT, TRAILING = r"\s#", r"\s+\z"


def bare_value(rest: Column) -> Column:
    """Of a bare value and the rest of its line, the value."""
    commented = F.regexp_instr(rest, F.lit(COMMENT))
    return F.when(commented > 0, F.substring(rest, F.lit(1), commented - 1)).otherwise(_trimmed(rest))


def _trimmed(s: Column) -> Column:
    return F.rtrim(s, F.lit(" \t\x0b\f\r"))


def value_spans(text: str) -> list[tuple[int, int]]:
    """Places of the values in one text, without their quotes."""

    def span(m: re.Match) -> tuple[int, int]:
        if m[6] is None:
            return m.span(2 if m[2] else 4)
        comment = re.search(COMMENT, m[6], re.ASCII)
        return m.start(6), m.start(6) + (comment.start() if comment else len(m[6].rstrip(" \t\x0b\f\r")))

    return [span(m) for m in re.finditer(VALUE, text, re.ASCII)]


def _masked(text: Column, salt: str, config: ScanConfig) -> Column:
    """Of a text that looks like an environment file: masked, mocks.  Each value is replaced where it stands."""
    part = lambda m, n: F.regexp_extract(m, VALUE, n)

    def piece(m: Column) -> Column:
        parts = F.struct(part(m, 1).alias("head"), part(m, 2).alias("twice"), part(m, 3).alias("rest2"), part(m, 4).alias("once"), part(m, 5).alias("rest1"), part(m, 6).alias("bare"))
        return bound(parts, told)

    def told(p: Column) -> Column:
        value = F.when(p["twice"] != "", p["twice"]).when(p["once"] != "", p["once"]).otherwise(bare_value(p["bare"]))
        return bound(value, lambda v: written(p, v, mock_for(v, F.lit("custom"), F.lit("env"), salt, config)))

    def written(p: Column, value: Column, mock: Column) -> Column:
        quote = F.when(p["twice"] != "", '"').when(p["once"] != "", "'").otherwise("")
        rest = F.when(p["bare"] != "", F.substring(p["bare"], F.length(value) + 1, F.length(p["bare"]))).otherwise(F.concat(p["rest2"], p["rest1"]))
        return bound(mock, lambda m: F.struct(F.concat(p["head"], quote, m, quote, rest).alias("line"), m.alias("mock"), value.alias("real")))

    def parts(pieces: Column) -> Column:
        lines = F.zip_with(F.split(text, VALUE, -1), pieces, lambda gap, p: F.concat(gap, F.coalesce(p["line"], F.lit(""))))
        mocks = F.array_distinct(F.transform(pieces, lambda p: F.struct(p["mock"].alias("mock"), p["real"].alias("real"))))
        return F.struct(F.when(F.size(pieces) > 0, F.array_join(lines, "")).otherwise(text).alias("masked"), mocks.alias("mocks"))

    return bound(F.transform(F.regexp_extract_all(text, F.lit(VALUE), 0), piece), parts)


def _unmasked(text: Column) -> Column:
    return F.struct(text.alias("masked"), F.array().cast("array<struct<mock:string,real:string>>").alias("mocks"))


def env_masked(text: Column, salt: str, config: ScanConfig | None = None) -> Column:
    """is_env, masked, mocks; a text that doesn't look like an environment file stays as it is."""
    whole = F.when(looks_like_env(text), _masked(text, salt, config or ScanConfig()))
    return bound(whole, lambda w: F.struct(w.isNotNull().alias("is_env"), F.coalesce(w["masked"], text).alias("masked"), F.coalesce(w["mocks"], _unmasked(text)["mocks"]).alias("mocks")))


def env_blocks_masked(text: Column, salt: str, config: ScanConfig | None = None) -> Column:
    """blocks, masked, mocks: the fenced blocks that look like environment files are masked, or a text without fences as a whole.

    `blocks` is the number of those in which a value was masked.
    """
    fences = F.regexp_extract_all(text, F.lit(FENCE), 0)
    counted = lambda e: F.when(F.size(e["mocks"]) > 0, 1).otherwise(0)

    def block(fence: Column) -> Column:
        head = F.regexp_extract(fence, "^[^\n]*\n", 0)
        put = lambda e: F.struct(counted(e).alias("n"), F.when(F.size(e["mocks"]) > 0, F.concat(head, e["masked"], F.lit("```"))).otherwise(fence).alias("masked"), e["mocks"].alias("mocks"))
        closed = bound(env_masked(F.regexp_extract(fence, FENCE, 1), salt, config), put)
        none = F.array().cast("array<struct<mock:string,real:string>>")
        return F.when(is_block(fence), closed).otherwise(F.struct(F.lit(0).alias("n"), fence.alias("masked"), none.alias("mocks")))

    def joined(done: Column) -> Column:
        parts = F.zip_with(F.split(text, FENCE, -1), done, lambda gap, b: F.concat(gap, F.coalesce(b["masked"], F.lit(""))))
        blocks = F.aggregate(done, F.lit(0), lambda n, b: n + b["n"])
        return F.struct(blocks.alias("blocks"), F.array_join(parts, "").alias("masked"), F.array_distinct(F.flatten(F.transform(done, lambda b: b["mocks"]))).alias("mocks"))

    whole = bound(env_masked(text, salt, config), lambda e: F.struct(counted(e).alias("blocks"), e["masked"].alias("masked"), e["mocks"].alias("mocks")))
    return F.when(F.exists(fences, is_block), bound(F.transform(fences, block), joined)).otherwise(whole)


def mask_env(df: DataFrame, key: str, text: str, salt: str, config: ScanConfig | None = None) -> DataFrame:
    """(id, text, is_env, masked, mocks); one pass of column functions, whatever the keys of rows are."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.withColumn("e", env_masked(F.col("text"), salt, config)).select("id", "text", "e.is_env", "e.masked", "e.mocks")

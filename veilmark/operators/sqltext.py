"""SQL texts with stand-ins for names and literals, by tokens and not by a grammar.

A text is cut into comments, strings, quoted and plain names, and all else, as its dialect quotes them; then only names and strings
that have a stand-in change, comments go, and every other character stays.  What a name is follows from where it stands: after
FROM, JOIN, INTO, UPDATE or TABLE, and after a comma of such a list, a table with its schema; else a column with what stands before
its dot; a name before a parenthesis is a function and stays; a name that WITH gives is no table.  Names have the stand-ins of their
scope (as `name_masks` gives them); where a name may be an alias or a column, the alias comes first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.batches import of_rows, small_batches
from veilmark.operators.detect import spread
from veilmark.operators.shared import written

# How dialects quote.
_LINE = {"mysql": r"--(?=\s)[^\n]*+|\#[^\n]*+|--\Z"}
_NAMES = {"mysql": r"`(?:[^`]|``)*+`", "bigquery": r"`[^`\n]*+`", "tsql": r"\[(?:[^\]]|\]\])*+\]|\"(?:[^\"]|\"\")*+\"", "spark": r"`(?:[^`]|``)*+`"}
_STRINGS = {"mysql": r"'(?:[^'\\]|''|\\.)*+'|\"(?:[^\"\\]|\"\"|\\.)*+\"", "bigquery": r"[rR]?(?:'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\")", "spark": r"[rR]?(?:'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\")"}
DIALECTS = ("ansi", "postgres", "mysql", "bigquery", "tsql", "spark", "snowflake")
NESTED = ("postgres", "tsql")  # comments within comments
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_KINDS = {"tag": "string", "plain": "word"}  # of groups that are named otherwise
_COMMENT_EDGE = re.compile(r"/\*|\*/")


class Token(NamedTuple):
    """kind: comment, string, quoted, word, mark or space; value: what a string or name says."""

    kind: str
    text: str
    value: str = ""


def lexer(dialect: str, for_strings: bool = False) -> re.Pattern:
    """One pattern whose groups are a token's kinds.  Spaces and words, of which there are most, are tried first; a word that may
    begin a string waits.  With `for_strings` runs of tokens that can't be strings, comments or quoted names are one match."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {', '.join(DIALECTS)}")
    strings = _STRINGS.get(dialect, r"(?:[nNxXbB]|[uU]&)?'(?:[^']|'')*+'")
    if dialect in ("postgres", "snowflake"):
        strings = r"[eE]'(?:[^'\\]|''|\\.)*+'|" + strings + r"|\$(?P<tag>[A-Za-z_][A-Za-z0-9_]*+|)\$.*?\$(?P=tag)\$"
    names = _NAMES.get(dialect, r'"(?:[^"]|"")*+"')
    word = r"[^\W\d][\w$]*+"
    plain = rf"(?![nNxXbBeErRuU]&?['\"]){word}"
    runs = rf"(?P<rest>(?:\s++|{plain}|\d[\w.]*+|[^\w\s'\"`\[$/#-])++)|" if for_strings else ""
    return re.compile(rf"{runs}(?P<space>\s++)|(?P<plain>{plain})|(?P<comment>{_LINE.get(dialect, r'--[^\n]*+')}|/\*)|(?P<string>{strings})|(?P<quoted>{names})|(?P<word>{word})|(?P<mark>\d[\w.]*+|.)", re.DOTALL)


def _comment_end(sql: str, at: int, nested: bool) -> int:
    """Where the comment that begins at a place ends; an open one takes the rest."""
    depth, at = 1, at + 2
    while depth:
        m = _COMMENT_EDGE.search(sql, at)
        if m is None:
            return len(sql)
        at = m.end()
        depth += 1 if m.group() == "/*" and nested else -1 if m.group() == "*/" else 0
    return at


def _said(text: str, dialect: str) -> str:
    """What a string says."""
    if text[0] == "$":
        return text[text.index("$", 1) + 1 : text.rindex("$", 0, -1)]
    head = text[: text.index(text[-1])].lower()
    inner, quote = text[len(head) + 1 : -1], text[-1]
    if "e" in head or dialect in ("mysql", "bigquery", "spark") and "r" not in head:
        inner = _ESCAPED.sub(r"\1", inner)
    return inner if dialect in ("bigquery", "spark") else inner.replace(quote * 2, quote)


def _pieces(sql: str, dialect: str, pattern: re.Pattern) -> list[tuple[str, str]]:
    """(kind, text) of a text's tokens."""
    out, at = [], 0
    while at < len(sql):
        end = len(sql)
        for m in pattern.finditer(sql, at):
            text = m.group()
            if text == "/*":
                end = _comment_end(sql, m.start(), dialect in NESTED)
                out.append(("comment", sql[m.start() : end]))
                break
            out.append((_KINDS.get(m.lastgroup, m.lastgroup), text))
        at = end
    return out


def _value(kind: str, text: str, dialect: str) -> str:
    """What a token says."""
    if kind == "string":
        return _said(text, dialect)
    return text[1:-1].replace(text[-1] * 2, text[-1]) if kind == "quoted" else text


def sql_tokens(sql: str, dialect: str, pattern: re.Pattern | None = None) -> Iterator[Token]:
    """The tokens of a text; their texts, joined, are the text.  A quote that nothing closes is a mark."""
    for kind, text in _pieces(sql, dialect, pattern or lexer(dialect)):
        yield Token(kind, text, _value(kind, text, dialect))


# Words after which a table stands, words that end a list of tables, functions with FROM inside, and words that are
# never a name.
_TABLE_AFTER = {"from", "join", "into", "update", "table"}
_LIST_ENDS = {"where", "group", "order", "having", "on", "using", "select", "set", "values", "limit", "union", "except", "intersect", "window", "qualify", "returning", "when"}
_FROM_INSIDE = {"extract", "substring", "trim", "overlay", "position"}
_WORDS = _TABLE_AFTER | _LIST_ENDS | {"as", "with", "recursive", "and", "or", "not", "in", "is", "null", "case", "then", "else", "end", "by", "asc", "desc", "distinct", "all", "left", "right", "inner", "outer", "full", "cross", "only", "lateral", "between", "like", "exists", "insert", "delete", "create", "if"}
# What a name, the one before its dot, and the one before that may be, where a table stands and elsewhere.
_OF_TABLE, _OF_COLUMN = (("table", "alias"), ("schema",)), (("alias", "column"), ("alias", "table"), ("schema",))


Word = tuple[int, str, str]  # where the token is among all; its kind; its text in lower case


def with_names(words: list[Word], value: Callable[[int], str]) -> set[str]:
    """Names that WITH gives: a name, AS and a parenthesis (a list of columns may stand between); `value` has what a token says."""
    found = set()
    for n in range(1, len(words)):
        if words[n - 1][2] not in ("with", "recursive", ",") or words[n][1] not in ("word", "quoted"):
            continue
        k = n + 1
        if k < len(words) and words[k][2] == "(":
            while k < len(words) and words[k][2] != ")":
                k += 1
            k += 1
        if k + 1 < len(words) and words[k][2] == "as":
            k += 1 + (words[k + 1][2] in ("materialized", "not"))
            if k < len(words) and words[k][2] in ("(", "materialized"):
                found.add(value(words[n][0]))
    return found


def _put(kind: str, text: str, name: str) -> str:
    if kind != "quoted":
        return name
    close = text[-1]
    return text[0] + name.replace(close, close * 2) + close


def _quoted_string(text: str, new: str, dialect: str) -> str:
    if text[0] == "$":
        tag = text[: text.index("$", 1) + 1]
        return tag + new + tag if tag not in new else "'" + new.replace("'", "''") + "'"
    quote = text[-1]
    head = text[: text.index(quote)]
    if "e" in head.lower() or dialect in ("mysql", "bigquery", "spark") and "r" not in head.lower():
        new = new.replace("\\", "\\\\")
        return head + quote + (new.replace(quote, "\\" + quote) if dialect in ("bigquery", "spark") else new.replace(quote, quote * 2)) + quote
    return head + quote + new.replace(quote, quote * 2) + quote


def masked_sql(sql: str, masks: dict[tuple[str, str], str], literals: dict[str, str], dialect: str = "ansi", keep_comments: bool = False, pattern: re.Pattern | None = None) -> str:
    """`sql` with the stand-ins of `masks` ((kind, name) to new name) and `literals` (value to new value)."""
    tokens = _pieces(sql, dialect, pattern or lexer(dialect))
    out = [text for _, text in tokens]
    value = lambda i: _value(*tokens[i], dialect)
    words = []
    for i, (kind, text) in enumerate(tokens):
        if kind == "space":
            continue
        if kind != "comment":
            words.append((i, kind, text.lower()))
            if kind == "string" and (said := value(i)) in literals:
                out[i] = _quoted_string(text, literals[said], dialect)
        elif not keep_comments:
            out[i] = "\n" if text[:2] != "/*" and "\n" not in "".join(x for _, x in tokens[i + 1 : i + 2]) and i + 1 < len(tokens) else " " if text[:2] == "/*" else ""
    given = with_names(words, value)
    frames: list[list] = [[False, False, False]]  # of each parenthesis: in a list of tables; a table comes next; FROM means nothing
    n, last = 0, len(words) - 1
    while n <= last:
        i, kind, low = words[n]
        before = words[n - 1][2] if n else ""
        if kind == "mark":
            if low == "(":
                frames.append([False, frames[-1][1], before in _FROM_INSIDE])
            elif low == ")":
                frames.pop()
                if not frames:
                    frames.append([False, False, False])
                frames[-1][1] = False
            elif low == "," and frames[-1][0]:
                frames[-1][1] = True
        elif kind == "word" and low in _TABLE_AFTER and not (low == "from" and (frames[-1][2] or before == "distinct")):
            frames[-1][:2] = [low in ("from", "join"), True]
        elif kind == "word" and low in _LIST_ENDS:
            frames[-1][:2] = [False, False]
        elif kind == "quoted" or kind == "word" and (low not in _WORDS or before == "."):
            chain = [i]
            while n + 2 <= last and words[n + 1][2] == "." and words[n + 2][1] in ("word", "quoted"):
                chain.append(words[n + 2][0])
                n += 2
            called = n < last and words[n + 1][2] == "("
            kinds = _OF_TABLE if frames[-1][1] else _OF_COLUMN
            for at, may in zip(reversed(chain), kinds):
                name = value(at)
                if called and at == chain[-1] and not frames[-1][1]:
                    continue
                if len(chain) == 1 and name in given:
                    may = ("alias",)
                new = next((masks[k, name] for k in may if masks.get((k, name)) is not None), None)
                if new is not None:
                    out[at] = _put(*tokens[at], new)
            frames[-1][1] = False
        n += 1
    return "".join(out)


def mask_sql(df: DataFrame, key: str, sql: str, masks: DataFrame, literals: DataFrame | None = None, dialect: str = "ansi", keep_comments: bool = False) -> DataFrame:
    """(id, sql), one row for each of `df`; `key` names a statement's scope, `masks` is (scope, kind, name, mask), `literals`
    (value, mask) or (scope, value, mask).

    A scope's stand-ins meet its statements by the scope; literals without a scope are looked up by the statements' own strings.
    Null texts stay null; scopes may repeat.  A statement's own names bound what it carries.  Statements are written when this is
    called if their strings are looked up.
    """
    pattern = lexer(dialect)
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("id"), F.col(sql).alias("sql")))
    if literals is not None and "scope" not in literals.columns:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()))  # both branches must see the same numbers
    given = F.when(F.col("mask").isNotNull(), F.struct("kind", "name", "mask"))  # no filter, as that would work out each mask twice
    named = masks.groupBy(F.col("scope").alias("of")).agg(F.collect_set(given).alias("names"))
    rows = rows.join(named, F.col("id") == F.col("of"), "left").drop("of")
    if literals is None:
        rows = rows.withColumn("values", F.array().cast("array<struct<value:string,mask:string>>"))
    elif "scope" in literals.columns:
        held = literals.groupBy(F.col("scope").alias("of")).agg(F.collect_set(F.struct("value", "mask")).alias("values"))
        rows = rows.join(held, F.col("id") == F.col("of"), "left").drop("of")
    else:
        said = sql_strings(rows.select(F.col("row").alias("key"), "sql"), "key", "sql", dialect).join(literals.select("value", "mask"), "value", "left")
        # a left join, as an inner one may broadcast all strings; without a stand-in they are not collected
        held = said.groupBy(F.col("id").alias("of")).agg(F.collect_set(F.when(F.col("mask").isNotNull(), F.struct("value", "mask"))).alias("values"))
        rows = rows.join(held, F.col("row") == F.col("of"), "left").drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, names, values in zip(batch.column(1).to_pylist(), of_rows(batch.column(2), "kind", "name", "mask"), of_rows(batch.column(3), "value", "mask")):
                known = {(kind, name): mask for kind, name, mask in names}
                out.append(None if text is None else masked_sql(text, known, dict(values), dialect, keep_comments, pattern))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "sql"])

    return small_batches(rows).select("id", "sql", "names", "values").mapInArrow(run, f"id {kind}, sql string")


def sql_strings(df: DataFrame, key: str, sql: str, dialect: str = "ansi") -> DataFrame:
    """(id, value) of the distinct strings of each statement."""
    pattern = lexer(dialect, for_strings=True)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                values = dict.fromkeys(_said(x, dialect) for kind, x in _pieces(text or "", dialect, pattern) if kind == "string")
                take += [i] * len(values)
                out += values
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(out, pa.string())], ["id", "value"])

    return df.select(F.col(key).alias("id"), F.col(sql).alias("sql")).mapInArrow(run, f"id {kind}, value string")

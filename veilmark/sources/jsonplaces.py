"""JSON texts read with the places of their values, so that a few strings can change and every other byte stays.

The reader keeps its own stack, so depth is bounded by memory only; numbers are never written again, so none changes its form.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

# A value, or the bracket that opens one, with the comma or closing bracket after it; in an object its name comes first.
_SPACE, _STRING = r"[ \t\n\r]*+", r'"[^"\\\x00-\x1f]*+(?:\\.[^"\\\x00-\x1f]*+)*+"'
_VALUE = rf"{_SPACE}(?:([{{\[])|({_STRING})|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)){_SPACE}([,}}\]]?)"
_MEMBER, _ITEM, _AFTER = re.compile(f"{_SPACE}({_STRING}){_SPACE}:{_VALUE}"), re.compile(f"(){_VALUE}"), re.compile(rf"{_SPACE}([,}}\]]?)")
_LONE = re.compile("[\ud800-\udfff]")
_WORDS = {"true": True, "false": False, "null": None}


class Text(str):
    """A string value; start and end are the places of its literal, quotes included."""

    start: int
    end: int


class Obj(dict):
    """An object; start and end are the places of its braces.  Of repeated names the last counts."""

    start: int
    end: int


class Arr(list):
    """An array; start and end are the places of its brackets."""

    start: int
    end: int


def readable(text: str) -> str:
    """`text` with halves of surrogate pairs, which have no UTF-8 form, as U+FFFD."""
    return _LONE.sub("�", text)


def _number(token: str) -> int | float:
    return int(token) if len(token) < 19 and token.lstrip("-").isdigit() else float(token)


def _string(literal: str, start: int) -> Text:
    text = Text(json.loads(literal) if "\\" in literal else literal[1:-1])
    text.start, text.end = start, start + len(literal)
    return text


def read_json(text: str):
    """The value of a JSON text; ValueError if it is none."""
    stack: list[tuple[Obj | Arr | None, str]] = []  # what each open value lies in, and its name there
    top: Obj | Arr | None = None  # the innermost open value
    at = 0
    while True:
        m = (_MEMBER if isinstance(top, Obj) else _ITEM).match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        name, mark, literal, number, word, after = m.groups()
        at = m.end()
        if name:
            name = json.loads(name) if "\\" in name else name[1:-1]
        if mark:
            value = Obj() if mark == "{" else Arr()
            value.start = m.start(2)
            stack.append((top, name))
            top = value
            if not after:
                continue
            if after == ",":
                raise ValueError(f"not expected at {at}")
        else:
            value = _string(literal, m.start(3)) if literal else _number(number) if number else _WORDS[word]
            if isinstance(top, Obj):
                top[name] = value
            elif top is not None:
                top.append(value)
        while after and after != "," and top is not None:  # the innermost value ends
            if (after == "}") != isinstance(top, Obj):
                raise ValueError(f"not expected at {at}")
            value, (top, name) = top, stack.pop()
            value.end = at
            if isinstance(top, Obj):
                top[name] = value
            elif top is not None:
                top.append(value)
            m = _AFTER.match(text, at)
            after, at = m.group(1), m.end()
        if top is None:
            if after or at < len(text):
                raise ValueError(f"more than one value at {at}")
            return value
        if not after:
            raise ValueError(f"no JSON at {at}")


def literal(value) -> str:
    """`value` as JSON, as short as can be; halves of surrogate pairs are escaped."""
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", out)


def spliced(text: str, changes: Iterable[tuple[int, int, str]]) -> str:
    """`text` with each (start, end, new) in its place; changes at one place come in the order given."""
    out, at = [], 0
    for start, end, new in sorted(changes, key=lambda c: c[:2]):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def added_name(obj: Obj, name: str, value) -> tuple[int, int, str]:
    """The change that puts one more name into an object."""
    return obj.end - 1, obj.end - 1, f"{',' if obj else ''}{literal(name)}:{literal(value)}"


def added_item(arr: Arr, value, first: bool = False) -> tuple[int, int, str]:
    """The change that puts one more item at the end of an array, or at its start."""
    new = literal(value)
    if first:
        return arr.start + 1, arr.start + 1, new + ("," if arr else "")
    return arr.end - 1, arr.end - 1, ("," if arr else "") + new

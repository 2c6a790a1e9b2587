"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby move their score.

Four base kinds (email, ip, card, phone) are found leftmost and without overlaps within a kind; a match that fails its check is
dropped, and nothing inside it is tried again.  Base spans always stay, whatever their score.  Further kinds (iban, ssn,
local_phone, short_card) are added where their score reaches `THRESHOLD` and no base span or better added span overlaps them.

Each text is read once in a task by itself and nothing is shuffled, so neither long texts nor repeated keys matter.  Every
pattern takes time linear in the text: runs that a pattern could start within are only tried from their first character.
Offsets count code points, ends are exclusive.  Null texts count as empty and have no spans; null and repeated keys and equal
rows stay, one row out for each row in; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.stages import small_batches

LOCAL = string.ascii_letters + string.digits + "._%+-"  # characters of an address before its @
BEFORE, AFTER = 48, 24  # characters around a span in which words count
RAISE, LOWER, THRESHOLD = 0.35, 0.35, 0.6
SPAN = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number: country and check digits last, letters as two digits, remainder 1."""
    packed = iban.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _card(value: str) -> bool:
    digits = digits_of(value)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _short_card(value: str) -> bool:
    digits = digits_of(value)
    return 13 <= len(digits) <= 15 and digits[0] in "3456" and luhn(digits)


def _ip(value: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in value.split("."))


def _phone(value: str) -> bool:
    return 8 <= len(digits_of(value)) <= 15


def _local_phone(value: str) -> bool:
    return 7 <= len(digits_of(value)) <= 12


def _ssn(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses by their @: what stands before one is looked up backwards, no further than the @ or the address before."""
    last = seen = 0
    for m in _DOMAIN.finditer(text):
        floor = max(last, seen)
        start = floor + len(text[floor : m.start()].rstrip(LOCAL))
        seen = m.start() + 1
        if start < m.start():
            last = m.end()
            yield start, last


_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: where it may be, what confirms it, its score, and the words that raise and lower that."""

    name: str
    pattern: str
    check: Callable[[str], bool]
    score: float
    raises: tuple[str, ...]
    lowers: tuple[str, ...] = ()
    base: bool = False


_EDGE = r"(?<![0-9A-Za-z])(?<![0-9][ .-])"
BASE = (
    Kind("email", "", lambda value: True, 0.9, ("mail", "contact", "@"), ("example",), True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, ("ip", "address", "host", "server", "adresse"), ("version", "release", "chapter"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.8, ("card", "visa", "credit", "karte", "carte", "tarjeta"), ("order", "isbn", "tracking"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, ("phone", "tel", "call", "mobile", "fax", "anruf", "móvil"), (), True),
)
ADDED = (
    Kind("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", mod97, 0.9, ("iban", "account", "konto", "compte", "cuenta", "bank")),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn, 0.4, ("ssn", "social security"), ("order", "part", "example")),
    Kind("local_phone", _EDGE + r"(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])(?![ .-][0-9])", _local_phone, 0.35, ("phone", "tel", "call", "mobile", "fax", "anruf", "móvil"), ("version", "isbn", "order")),
    Kind("short_card", _EDGE + r"[3-6](?:[\x20-]?[0-9]){12,14}(?![0-9A-Za-z])(?![ .-][0-9])", _short_card, 0.4, ("card", "amex", "american express", "diners", "karte", "carte", "tarjeta"), ("order", "isbn", "tracking")),
)
_PATTERNS = {k.name: re.compile(k.pattern) for k in BASE + ADDED if k.pattern}


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(rf"(?<!\w){re.escape(w)}" if w[0].isalnum() else re.escape(w) for w in words or ("(?!)",)) if words else "(?!)")


_RAISES, _LOWERS = ({k.name: _any_word(getattr(k, side)) for k in BASE + ADDED} for side in ("raises", "lowers"))


def scored(kind: Kind, text: str, start: int, end: int) -> float:
    """The kind's score, moved by words within BEFORE and AFTER characters; words in the span itself don't count."""
    near = text[max(0, start - BEFORE) : start].lower() + "\n" + text[end : end + AFTER].lower()
    moved = kind.score + RAISE * bool(_RAISES[kind.name].search(near)) - LOWER * bool(_LOWERS[kind.name].search(near))
    return round(min(1.0, max(0.0, moved)), 2)


def proposals(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    places = _emails(text) if kind.name == "email" else (m.span() for m in _PATTERNS[kind.name].finditer(text))
    return ((start, end) for start, end in places if kind.check(text[start:end]))


def personal_data(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of one text: by kind as listed above, then by start."""
    found = [(k.name, a, b, scored(k, text, a, b), True) for k in BASE for a, b in proposals(k, text)]
    offered = [(-s, a, n, b) for n, k in enumerate(ADDED) for a, b in proposals(k, text) if (s := scored(k, text, a, b)) >= THRESHOLD]
    if offered:
        taken = _Taken((a, b) for _, a, b, _, _ in found)
        kept = sorted((n, a, b, -s) for s, a, n, b in sorted(offered) if taken.add(a, b))
        found += [(ADDED[n].name, a, b, s, False) for n, a, b, s in kept]
    return found


class _Taken:
    """Places that are taken, by cells of 32 characters, so that a text with very many spans costs no more for each."""

    def __init__(self, spans):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for a, b in spans:
            self._put(a, b)

    def _put(self, a: int, b: int) -> None:
        for cell in range(a >> 5, (b - 1 >> 5) + 1):
            self.cells.setdefault(cell, []).append((a, b))

    def add(self, a: int, b: int) -> bool:
        """Take a place if none of it is taken."""
        if any(x < b and a < y for cell in range(a >> 5, (b - 1 >> 5) + 1) for x, y in self.cells.get(cell, ())):
            return False
        self._put(a, b)
        return True


def pii_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of each row of `df`; spans are (kind, start, end, score, base), by kind and then start."""
    element = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, columns = [0], [[], [], [], [], []]
            for x in batch.column(1):
                for span in personal_data(x.as_py() or ""):
                    for column, value in zip(columns, span):
                        column.append(value)
                sizes.append(len(columns[0]))
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, element)], fields=list(element))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], [key, "spans"])

    kind = df.schema[key].dataType.simpleString()
    return small_batches(df).select(F.col(key), F.col(text).alias("_text")).mapInArrow(read, f"`{key}` {kind}, spans {SPAN}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(df: DataFrame) -> DataFrame:
    """One row a document: the number of base spans of each base kind, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda name: F.filter("spans", lambda s: s["base"] & (s["kind"] == name))
    counts = [F.size(of_kind(k.name)).cast("long").alias(f"n_{k.name}") for k in BASE]
    return pii_spans(df).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask_pii(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """(key, masked): each span whose score is at least `least` gives way to its kind in brackets; of overlapping ones the first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                if (value := x.as_py()) is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for start, _, end, kind in sorted((a, -b, b, k) for k, a, b, score, _ in personal_data(value) if score >= least):
                    if start >= at:
                        parts += [value[at:start], f"[{kind.upper()}]"]
                        at = end
                    elif end > at:
                        at = end
                out.append("".join([*parts, value[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "masked"])

    kind = df.schema[key].dataType.simpleString()
    return small_batches(df).select(F.col(key), F.col(text).alias("_text")).mapInArrow(read, f"`{key}` {kind}, masked string")

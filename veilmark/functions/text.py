"""Column functions on strings: entropy, character classes, windows, masks and hashes.  Offsets count code points from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_LENGTHS = (32, 40, 56, 64, 96, 128)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty string."""
    kinds = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    count = lambda c: F.length(s) - F.length(F.replace(s, c))
    return F.aggregate(F.transform(kinds, lambda c: count(c) / F.length(s)), F.lit(0.0), lambda total, p: total - p * F.log2(p))


def has_char_mix(s: Column) -> Column:
    """Two or more of lower case, upper case and digits."""
    return sum(s.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]")) >= 2


def is_hash_or_uuid(s: Column) -> Column:
    digest = s.rlike("^[0-9a-fA-F]+$") & F.length(s).isin(*HASH_LENGTHS)
    return digest | s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def is_identifier(s: Column) -> Column:
    """Words joined by `_ - . =`, most of them short or of one character class."""
    parts = F.filter(F.split(s, "[_\\-.=]"), lambda p: p != "")
    plain = F.filter(parts, lambda p: (F.length(p) <= 6) | ~has_char_mix(p))
    return (F.size(parts) >= 2) & (F.size(plain) >= F.size(parts) * 0.6)


def window(text: Column, start: Column, end: Column, radius: int) -> Column:
    """Lower-cased text from `radius` before `start` to `radius` after `end`."""
    first = F.greatest(start - radius, F.lit(0))
    return F.lower(F.substring(text, first + 1, end + radius - first))


def has_any(s: Column, words: list[str]) -> Column:
    """Whether one of the lower-case `words` is a substring."""
    return reduce(Column.__or__, [F.contains(s, F.lit(w)) for w in words], F.lit(False))


def mask_value(v: Column) -> Column:
    """The first 4 characters, then at most 24 stars; short values are all stars."""
    stars = F.least(F.length(v) - 4, F.lit(24))
    return F.when(F.length(v) <= 4, F.repeat(F.lit("*"), F.length(v))).otherwise(F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), stars)))


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over the characters' codes, as a non-negative long."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def base36_tag(s: Column, length: int) -> Column:
    """`length` base-36 characters that follow from `s`, 7 from each hash; the next hash is over what is there and `s`."""
    out = F.lower(F.lpad(F.conv(fnv1a(s).cast("string"), 10, 36), 7, "0"))
    whole = out
    for _ in range((length - 1) // 7):
        whole = F.concat(whole, F.lower(F.lpad(F.conv(fnv1a(F.concat(whole, s)).cast("string"), 10, 36), 7, "0")))
    return F.substring(whole, 1, length)


def short_hash(s: Column, salt: str, length: int = 6) -> Column:
    """The first base-36 digits of the first 16 hex digits of SHA-256 over `salt:s`, with zeros before them if they are fewer."""
    return F.lpad(F.lower(F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), s), 256), 1, 16), 16, 36)), length, "0")


def match_starts(text: Column, regex: str) -> tuple[Column, Column]:
    """(matches, starts) of a regex that never matches the empty string: gaps and matches alternate."""
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), 0)
    upto = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda n, m: n + F.length(m))
    return found, F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), upto)).otherwise(F.array().cast("array<int>"))


def bound(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once however often `use` has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

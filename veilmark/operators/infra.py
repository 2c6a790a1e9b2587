"""Names and addresses of a company's own machines in text: private addresses, internal hosts, home paths, own words."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.text import short_hash

# Labels that make a host internal, and the patterns of private addresses, hosts and home paths.
INTERNAL_LABELS = ("internal", "corp", "local", "intranet", "lan", "vpc", "k8s")
PRIVATE_IP = r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"
# A host may end a sentence or stand before a dash; it has at most 127 labels, which bounds the matcher's stack.
HOSTNAME = r"(?<![\w.-])(?:[a-zA-Z0-9-]+\.){1,126}[a-zA-Z0-9-]*[a-zA-Z0-9](?![\w]|[.-]+\w)"
HOME_PATHS = (r"/(?:Users|home)/[^/\s\"'`]+/[^\s\"'`]+", r"[A-Za-z]:\\Users\\[^\\\s\"'`]+\\[^\s\"'`]+")


@dataclass(frozen=True)
class InfraConfig:
    """What counts as internal.  `domains` are the organisation's own, `patterns` and `words` its further secrets."""

    salt: str
    labels: tuple[str, ...] = INTERNAL_LABELS
    domains: tuple[str, ...] = ()
    private_addresses: bool = True
    paths: tuple[str, ...] = HOME_PATHS
    patterns: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    hash_length: int = 6
    marker: str = "VEILMARK_MASK_"


def mask_host(host: Column, label: Column, config: InfraConfig) -> Column:
    """A stand-in that keeps the internal label, and nothing else of the name."""
    tail = F.when(label.isNull(), F.lit("")).otherwise(F.concat(F.lit("."), label))
    return F.concat(F.lit("host-"), short_hash(host, config.salt, config.hash_length), tail)


def mask_private_ip(ip: Column, config: InfraConfig) -> Column:
    """Another private address: three pairs of the hash's base-36 digits as numbers below 256."""
    tag = short_hash(ip, config.salt, 8)
    byte = lambda at: (F.conv(F.substring(tag, at, 2), 36, 10).cast("long") % 256).cast("string")
    return F.concat(F.lit("10."), byte(1), F.lit("."), byte(3), F.lit("."), byte(5))


def mask_path(path: Column, config: InfraConfig) -> Column:
    return F.concat(F.lit("/masked/path_"), short_hash(path, config.salt, config.hash_length))


def mask_word(word: Column, config: InfraConfig) -> Column:
    return F.concat(F.lit(config.marker), F.upper(short_hash(word, config.salt, config.hash_length)))


def replaced_in_place(text: Column, pattern: str, mask) -> Column:
    """`text` with each match of `pattern` replaced where it stands: gaps and masks in turn."""
    gaps = F.split(text, pattern, -1)
    masks = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), mask)
    joined = F.zip_with(gaps, masks, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def _internal_host(config: InfraConfig):
    def mask(host: Column) -> Column:
        low = F.lower(host)
        parts = F.split(low, r"\.")
        label = F.coalesce(*[F.when(F.array_contains(parts, x.lower()), F.lit(x)) for x in config.labels], F.lit(None).cast("string"))
        own = F.lit(False)
        for domain in config.domains:
            own = own | (low == domain.lower()) | low.endswith("." + domain.lower())
        return F.when(label.isNotNull() | own, mask_host(host, label, config)).otherwise(host)

    return mask


def mask_infra(text: Column, config: InfraConfig) -> Column:
    """`text` with private addresses, then internal hosts, then paths, then own patterns and words masked; null stays null.

    Equal names get equal masks.  Hosts count as internal by a label anywhere in them or by an own domain; others stay.
    """
    out = replaced_in_place(text, PRIVATE_IP, lambda m: mask_private_ip(m, config)) if config.private_addresses else text
    out = replaced_in_place(out, HOSTNAME, _internal_host(config))
    for path in config.paths:
        out = replaced_in_place(out, path, lambda m: mask_path(m, config))
    for pattern in (*config.patterns, *("(?i)" + re.escape(w) for w in config.words if w)):
        out = replaced_in_place(out, pattern, lambda m: mask_word(m, config))
    return out

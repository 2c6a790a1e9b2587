"""An organisation's policy document as rules and settings: own patterns, blocked terms, internal hosts and domains.

The document is JSON.  Reading it is all or nothing: `load_policy` either returns a policy or raises an error that names
everything wrong, so a typo never switches protection off unnoticed.
"""

from __future__ import annotations

import json
import re
import re._constants as kinds
import re._parser as sre_parse
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from veilmark.functions.ambiguity import ambiguity
from veilmark.operators.config import ScanConfig
from veilmark.operators.infra import INTERNAL_LABELS, InfraConfig
from veilmark.sources.rules import Rule

MOST_CHARACTERS, WIDEST_WINDOW, WINDOW = 4096, 256, 16
# Character kinds, known formats, and the names that a document may use.
LETTERS = {"digits": r"\d", "alpha": "[A-Za-z]", "alnum": "[A-Za-z0-9]", "hex": "[0-9A-Fa-f]", "upper": "[A-Z]", "lower": "[a-z]", "upperalnum": "[A-Z0-9]"}
APART, ENDS = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
KNOWN = {
    "ipv4": (APART + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)" + ENDS, False),
    "email": (APART + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}" + ENDS, True),
    "uuid": (r"(?<![0-9A-Fa-f-])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f-])", False),
    "mac": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", False),
    "us_phone": (r"(?<!\d)(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}(?!\d)", False),
    "iban": (r"(?<![A-Z0-9])[A-Z]{2}\d{2}[A-Z0-9]{10,30}(?![A-Z0-9])", False),
}
LANGUAGES = ["go", "java", "csharp", "kotlin", "python", "cobol", "rust", "c", "cpp"]
GRAINS = ["aggregate", "per_incident"]


@dataclass(frozen=True)
class Policy:
    """What a document asks for."""

    rules: tuple[Rule, ...] = ()
    suppressed: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    switches: dict = field(default_factory=dict)
    logging: dict = field(default_factory=dict)
    languages: tuple[str, ...] | None = None
    prefixes: dict = field(default_factory=dict)
    scopes: tuple[str, ...] = ()

    def scan_config(self, config: ScanConfig | None = None) -> ScanConfig:
        config = config or ScanConfig()
        return config.having(custom_rules=(*config.custom_rules, *self.rules), suppressed_rule_ids=(*config.suppressed_rule_ids, *self.suppressed))

    def infra_config(self, salt: str) -> InfraConfig:
        return InfraConfig(salt, labels=(*INTERNAL_LABELS, *(x for x in self.labels if x not in INTERNAL_LABELS)), domains=self.domains)


def strings(x) -> bool:
    return isinstance(x, list) and all(isinstance(y, str) for y in x)


def number(x, low: int, high: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


HINTED = 3  # letters that may differ for a name to be taken for another


def distance(a: str, b: str, most: int) -> int:
    """Letters to insert, delete or change to make `b` of `a`; most + 1 if they are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def meant(name: str, names: list[str]) -> str:
    """A hint at the known name that is nearest, if one is near."""
    near = min(((distance(name, n, HINTED), n) for n in names), default=(HINTED + 1, ""))
    return f" (is {near[1]!r} meant?)" if near[0] <= HINTED else ""


class _Reader:
    """Gathers what is wrong while it reads."""

    def __init__(self):
        self.wrong: list[str] = []

    def need(self, fine: bool, where: str, what: str) -> bool:
        if not fine:
            self.wrong.append(f"{where}: {what}")
        return fine

    def only(self, x: dict, names: list[str], where: str) -> None:
        for name in x:
            self.need(name in names, where, f"unknown field {name!r}{meant(name, names)}")

    def format(self, x, where: str) -> str:
        if not self.need(isinstance(x, dict), where, "must be an object with kind and length, or min and max"):
            return ""
        self.only(x, ["kind", "length", "min", "max"], where)
        fine = self.need(x.get("kind") in LETTERS, where, "kind must be one of " + ", ".join(LETTERS))
        if "length" in x:
            fine &= self.need("min" not in x and "max" not in x and number(x["length"], 1, MOST_CHARACTERS), where, f"needs either length, or min and max, from 1 to {MOST_CHARACTERS}")
            return LETTERS[x["kind"]] + f"{{{x['length']}}}" if fine else ""
        low, high = x.get("min"), x.get("max")
        fine &= self.need(number(low, 1, MOST_CHARACTERS) and number(high, 1, MOST_CHARACTERS) and low <= high, where, f"needs either length, or min and max, from 1 to {MOST_CHARACTERS}")
        return LETTERS[x["kind"]] + f"{{{low},{high}}}" if fine else ""

    def words(self, x, where: str) -> str:
        fine = self.need(strings(x) and len(x) > 0 and all(x), where, "must be a list of texts that aren't empty")
        return "|".join(re.escape(w) for w in x) if fine else ""

    def match(self, m, where: str, examples) -> tuple[str, bool, int, int]:
        """(regex, ignore case, group, tier); an empty regex if something is wrong."""
        kind = m.get("type") if isinstance(m, dict) else None
        if not self.need(kind in ("prefix", "context", "list", "known", "regex"), where, "type must be prefix, context, list, known or regex"):
            return "", False, 0, 1
        if kind == "prefix":
            self.only(m, ["type", "prefix", "format", "caseInsensitive"], where)
            head, tail = self.words([m["prefix"]] if isinstance(m.get("prefix"), str) else None, f"{where}.prefix"), self.format(m.get("format"), f"{where}.format")
            return APART + head + tail + ENDS if head and tail else "", bool(m.get("caseInsensitive")), 0, 1
        if kind == "context":
            self.only(m, ["type", "keywords", "value", "window"], where)
            near, value, width = self.words(m.get("keywords"), f"{where}.keywords"), self.format(m.get("value"), f"{where}.value"), m.get("window", WINDOW)
            fine = self.need(number(width, 1, WIDEST_WINDOW), f"{where}.window", f"must be from 1 to {WIDEST_WINDOW}")
            return f"(?:{near})[^\\n]{{0,{width}}}({value})" if near and value and fine else "", True, 1, 2
        if kind == "list":
            self.only(m, ["type", "terms", "wholeWord", "caseInsensitive"], where)
            terms = self.words(m.get("terms"), f"{where}.terms")
            return _listed(terms, bool(m.get("wholeWord"))) if terms else "", bool(m.get("caseInsensitive")), 0, 1
        if kind == "known":
            self.only(m, ["type", "format"], where)
            fine = self.need(m.get("format") in KNOWN, where, "format must be one of " + ", ".join(KNOWN))
            return (*KNOWN[m["format"]], 0, 1) if fine else ("", False, 0, 1)
        self.only(m, ["type", "advanced", "source", "flags"], where)
        source, flags = m.get("source"), m.get("flags", "")
        fine = self.need(isinstance(source, str) and source != "", where, "source must be a text")
        fine &= self.need(isinstance(flags, str) and set(flags) <= set("gi"), where, "flags may be g and i")
        fine &= self.need(m.get("advanced") is True, where, "a raw regex needs advanced: true")
        fine &= self.need(bool(examples), where, "a raw regex needs at least one example that it matches")
        if fine and (risk := regex_risk(source)):
            fine = self.need(False, where, risk)
        return source if fine else "", "i" in flags if isinstance(flags, str) else False, 0, 2

    def pattern(self, p, where: str) -> Rule | None:
        if not self.need(isinstance(p, dict), where, "must be an object"):
            return None
        self.only(p, ["name", "id", "action", "match", "examples"], where)
        fine = self.need(isinstance(p.get("name"), str) and p["name"].strip() != "", where, "needs a name")
        fine &= self.need("id" not in p or isinstance(p["id"], str) and p["id"] != "", where, "id must be a text")
        fine &= self.need(p.get("action", "swap") in ("swap", "block"), where, "action must be swap or block")
        shown = p.get("examples", {"match": []})
        fine &= self.need(isinstance(shown, dict) and strings(shown.get("match")) and strings(shown.get("noMatch", [])), where, "examples must have lists match and noMatch")
        regex, ignore_case, group, tier = self.match(p.get("match"), f"{where}.match", isinstance(shown, dict) and shown.get("match"))
        if not regex or not fine:
            return None
        try:
            made = re.compile(regex, re.ASCII | (re.IGNORECASE if ignore_case else 0))
        except re.error as e:
            self.need(False, where, f"the regex can't be read: {e}")
            return None
        for text in shown["match"]:
            self.need(made.search(text) is not None, where, f"does not match its example {text!r}")
        for text in shown.get("noMatch", []):
            self.need(made.search(text) is None, where, f"matches {text!r}, which it should not")
        name = re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", p["name"].lower())) or "custom"
        listed = p["match"] if p["match"]["type"] == "list" else {}
        own = {"terms": tuple(listed.get("terms", ())), "whole_word": bool(listed.get("wholeWord"))}
        return Rule(p.get("id", f"policy.{name}"), "custom", tier, "high", p.get("action") == "block", regex, ignore_case, group, mask_hint=p["name"], **own)

    def flags(self, x, names: list[str], where: str, allowed: list) -> dict:
        if not self.need(isinstance(x, dict), where, "must be an object"):
            return {}
        self.only(x, names, where)
        for name in names:
            self.need(name not in x or x[name] in allowed and isinstance(x[name], type(allowed[0])), f"{where}.{name}", f"must be one of {allowed}")
        return x


def _listed(terms: str, whole_word: bool) -> str:
    return f"{APART}(?:{terms}){ENDS}" if whole_word else f"(?:{terms})"


def regex_risk(source: str) -> str:
    """Why a regex may take more than linear time: something repeated that itself repeats, or texts that it can match in very
    many ways; empty if nothing is seen."""

    def repeats(parts, inside: bool) -> bool:
        for kind, value in parts:
            if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
                low, high, inner = value
                varies = high != low and high >= 2
                if inside and varies or repeats(inner, inside or varies):
                    return True
            elif kind is kinds.SUBPATTERN and repeats(value[-1], inside):
                return True
            elif kind is kinds.BRANCH and any(repeats(b, inside) for b in value[1]):
                return True
            elif kind in (kinds.ASSERT, kinds.ASSERT_NOT) and repeats(value[1], inside):
                return True
        return False

    try:
        if repeats(sre_parse.parse(source), False):
            return "a repetition within a repetition may take exponential time"
        told = ambiguity(source)
        return "too long to be checked" if told == "too long" else f"it can match one text in so many ways that it may take {told} time" if told else ""
    except re.error as e:
        return f"the regex can't be read: {e}"


def load_policy(document: str) -> Policy:
    """The policy of a JSON `document`; a ValueError that names all that is wrong."""
    r = _Reader()
    try:
        raw = json.loads(document)
    except ValueError as e:
        raise ValueError(f"the policy is no JSON: {e}") from None
    if not isinstance(raw, dict):
        raise ValueError("the policy must be an object")
    lists = ["internalScopes", "internalDomains", "internalHosts", "internalTlds", "blocklist"]
    r.only(raw, ["version", "patterns", *lists, "languages", "internalPackagePrefixes", "policy", "logging"], "policy")
    r.need(raw.get("version") == 1 and not isinstance(raw.get("version"), bool), "version", "must be 1")
    held = {name: raw[name] if r.need(strings(raw.get(name, [])), name, "must be a list of texts") and name in raw else [] for name in lists}
    patterns = raw.get("patterns", [])
    rules = [r.pattern(p, f"patterns[{i}]") for i, p in enumerate(patterns)] if r.need(isinstance(patterns, list), "patterns", "must be a list") else []
    domains = [*held["internalDomains"], *held["internalHosts"]]
    for listed, own, label, whole_word in ((domains, "policy.internal_host", "internal host", False), (held["blocklist"], "policy.blocklist", "blocklisted term", True)):
        if terms := [t for t in listed if t]:
            rules.append(Rule(own, "custom", 1, "high", False, _listed("|".join(map(re.escape, terms)), whole_word), True, mask_hint=label, terms=tuple(terms), whole_word=whole_word))
    seen: set[str] = set()
    for rule in filter(None, rules):
        r.need(rule.id not in seen, rule.id, "there twice")
        seen.add(rule.id)
    languages = raw.get("languages")
    r.need(languages is None or strings(languages) and all(x in (*LANGUAGES, "defaults", "all", "none") for x in languages), "languages", "must be a list of " + ", ".join(LANGUAGES))
    prefixes = raw.get("internalPackagePrefixes", {})
    if r.need(isinstance(prefixes, dict), "internalPackagePrefixes", "must be an object"):
        r.only(prefixes, LANGUAGES, "internalPackagePrefixes")
        for name, x in prefixes.items():
            r.need(strings(x), f"internalPackagePrefixes.{name}", "must be a list of texts")
    switches = dict(raw.get("policy", {})) if isinstance(raw.get("policy", {}), dict) else raw["policy"]
    pii = switches.pop("pii", {}) if isinstance(switches, dict) else {}
    switches = r.flags(switches, ["sql", "code", "fileReads", "members"], "policy", [True, False])
    pii = r.flags(pii, ["creditCard", "ssn"], "policy.pii", [True, False])
    logging = raw.get("logging", {})
    if r.need(isinstance(logging, dict), "logging", "must be an object"):
        r.only(logging, ["default", "categories"], "logging")
        r.need(logging.get("default", GRAINS[0]) in GRAINS, "logging.default", f"must be one of {GRAINS}")
        r.flags(logging.get("categories", {}), ["secrets", "pii", "custom", "code", "sql"], "logging.categories", GRAINS)
    if r.wrong:
        raise ValueError("; ".join(r.wrong))
    off = (["pii.credit_card"] if pii.get("creditCard") is False else []) + (["pii.ssn_context", "pii.ssn_dashed"] if pii.get("ssn") is False else [])
    return Policy(tuple(filter(None, rules)), tuple(off), tuple(domains), tuple(held["internalTlds"]), switches, logging, None if languages is None else tuple(languages), prefixes, tuple(x.removesuffix("*") for x in held["internalScopes"]))


class PolicyStore:
    """A policy from elsewhere with the last good copy: snapshots in a folder, promoted only after they were checked.

    `fetch` brings the document's text and may raise OSError.  `load` gives the policy and where it came from: `fetched` or `kept`.
    """

    def __init__(self, spark, folder: str, fetch: Callable[[], str]):
        self.spark, self.folder, self.fetch = spark, folder.rstrip("/"), fetch

    def kept(self) -> str | None:
        """The last good document."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return None
        done = [s.getPath() for s in store.listStatus(top) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            return None
        return self.spark.read.parquet(max(done, key=lambda p: p.getName()).toString()).first()[0]

    def load(self) -> tuple[Policy, str]:
        """A document that is brought and holds is kept; one that doesn't hold is an error and leaves the kept one as it is; where none
        is brought, the kept one is checked again and used, and without one that is an error."""
        try:
            document = self.fetch()
        except OSError as e:
            document = self.kept()
            if document is None:
                raise ValueError(f"the policy can't be fetched ({e}) and none is kept") from e
            return load_policy(document), "kept"
        policy = load_policy(document)
        if document != self.kept():
            self.spark.createDataFrame([(document,)], "value string").coalesce(1).write.parquet(f"{self.folder}/{time.time_ns():020d}")
        return policy, "fetched"

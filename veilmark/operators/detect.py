"""Finding sensitive values: candidates, context, and the choice among overlapping ones.

`candidates` is one Arrow batch function that only lists matches; everything that judges a match (validators, windows,
entropy, allowlist, environment, confidence) is built of Spark's own functions on one row a candidate, which has the text
around the match and not the whole text.  Overlaps are resolved by a fold over a text's findings in order.
"""

from __future__ import annotations

import re
import re._parser as sre_parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.needles import Needles, Terms
from veilmark.functions.text import entropy, has_any, has_char_mix, is_hash_or_uuid, is_identifier
from veilmark.operators.config import CONTEXT_WORDS, DEV_WORDS, PROD_WORDS, ScanConfig

SPACE = "[\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
# Fixed value: an assignment of a quoted or bare value.
ASSIGNMENT = r"(?:\A|[\n;,(])\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(['\"]?)([^\n'\"]{6,})\2"
FINDING = "layer string, type string, confidence string, start int, end int, value string, environment string, reason string, rule_id string, mask_hint string"
_LAYER_RANK, _CONFIDENCE_RANK = {"known_pattern": 3, "structural": 2, "entropy": 1}, {"low": 1, "medium": 2, "high": 3}


def python_regex(rule_regex: str, ignore_case: bool = False) -> re.Pattern:
    """ASCII word classes and boundaries, and white space as Unicode has it."""
    text, out, in_class, i = rule_regex, [], False, 0
    while i < len(text):
        pair = text[i : i + 2]
        if pair == "\\s":
            out.append(SPACE[1:-1] if in_class else SPACE)
            i += 2
            continue
        if text[i] == "\\":
            out.append(pair)
            i += 2
            continue
        in_class = text[i] == "[" or in_class and text[i] != "]"
        out.append(text[i])
        i += 1
    return re.compile("".join(out), re.ASCII | (re.IGNORECASE if ignore_case else 0))


def needles(pattern: str, ignore_case: bool) -> list[str]:
    """Strings of which each match of `pattern` holds at least one; empty if none is known.  Lower-cased with `ignore_case`."""

    def of(parts) -> list[str]:
        best: list[str] = []
        run = ""

        def better(found: list[str]) -> None:
            nonlocal best
            if found and (not best or min(map(len, found)) > min(map(len, best))):
                best = found

        for kind, value in parts:
            if kind is sre_parse.LITERAL:
                run += chr(value)
                continue
            better([run] if run else [])
            run = ""
            if kind is sre_parse.SUBPATTERN:
                better(of(value[-1]))
            elif kind in (sre_parse.MAX_REPEAT, sre_parse.MIN_REPEAT) and value[0] >= 1:
                better(of(value[2]))
            elif kind is sre_parse.BRANCH:
                each = [of(branch) for branch in value[1]]
                better([x for found in each for x in found] if all(each) else [])
        better([run] if run else [])
        return best

    found = of(sre_parse.parse(pattern))
    return sorted({x.lower() for x in found} if ignore_case else set(found))


class Matcher:
    """Lists the matches in a text.  Rules whose needles, or whose context words if they need any, aren't there are not tried."""

    COLUMNS = "seq int, kind string, rule_id string, start int, `end` int, value string, key string, around string, tier int, type string, base string, validator string, least_bits double, words array<string>, mask_hint string"

    def __init__(self, config: ScanConfig):
        self.rules, self.always = [], []
        self.lists: list[tuple[str, Terms, tuple]] = []
        self.exact: dict[str, list[int]] = {}  # needles in the text, and in the lower-cased text, with the rules that need them
        self.lower: dict[str, list[int]] = {}
        for r in config.every_rule():
            about = (r.tier, r.type, r.confidence, r.validator, float(r.entropy), [w.lower() for w in r.context], r.mask_hint)
            if r.terms:
                self.lists.append((r.id, Terms(r.terms, r.whole_word, r.ignore_case), about))
                continue
            held, at = needles(r.regex, r.ignore_case), len(self.rules)
            lower = r.ignore_case
            if not held and r.tier == 3 and not r.context_regex:
                held, lower = about[5], True
            self.rules.append((r.id, python_regex(r.regex, r.ignore_case), r.group, about))
            self.always += [] if held else [at]
            for needle in held:
                (self.lower if lower else self.exact).setdefault(needle, []).append(at)
        self.exact_needles, self.lower_needles = Needles(self.exact), Needles(self.lower)
        self.assignment, self.token = python_regex(ASSIGNMENT), re.compile(r"[A-Za-z0-9\-_+/=.]{%d,}" % config.entropy_min_length)
        self.radius, self.context = config.context_window, config.require_context_for_entropy

    def rows(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        low = text.lower()

        def add(kind: str, rule: str, start: int, value: str, key: str, about: tuple) -> None:
            around = text[max(0, start - self.radius) : start + len(value) + self.radius]
            out.append((len(out), kind, rule, start, start + len(value), value, key, around, *about))

        tried = set(self.always)
        for where, known, needles_of in ((text, self.exact, self.exact_needles), (low, self.lower, self.lower_needles)):
            for needle in needles_of.present(where):
                tried.update(known[needle])
        for at in sorted(tried):
            rule_id, pattern, group, about = self.rules[at]
            for m in pattern.finditer(text):
                value, start = m.group(), m.start()
                if group and m.group(group) is not None:
                    start, value = m.start(group), m.group(group)
                if value:
                    add("rule", rule_id, start, value, "", about)
        for rule_id, terms, about in self.lists:
            for start, end in terms.spans(text):
                add("rule", rule_id, start, text[start:end], "", about)
        if not self.context or any(w in low for w in CONTEXT_WORDS):
            for m in self.token.finditer(text):
                add("entropy", "entropy.high_entropy_string", m.start(), m.group(), "", NO_RULE)
        if "=" in text or ":" in text:
            for m in self.assignment.finditer(text):
                raw = m.group(3)
                if value := raw.strip():
                    add("structural", "structural.assignment", m.start(3) + len(raw) - len(raw.lstrip()), value, m.group(1).lower(), NO_RULE)
        return out


NO_RULE = (0, "", "", "", 0.0, [], "")


def candidates(df: DataFrame, key: str, text: str, config: ScanConfig) -> DataFrame:
    """Every match as a row of its own: `key` as id, the match, the text around it, and what its rule says of it."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(config)
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string()]
        names = [c.split()[0].strip("`") for c in Matcher.COLUMNS.split(", ")]

        def batch_of(ids: pa.Array, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *names])

        for batch in batches:
            take: list[int] = []
            rows: list[tuple] = []
            for i, x in enumerate(batch.column(1)):
                if value := x.as_py():
                    got = matcher.rows(value)
                    take += [i] * len(got)
                    rows += got
                    if len(rows) >= 20_000:
                        yield batch_of(batch.column(0), take, rows)
                        take, rows = [], []
            yield batch_of(batch.column(0), take, rows)

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text")))
    return rows.mapInArrow(match, f"id {kind}, {Matcher.COLUMNS}")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out anew where it has fewer partitions than there are cores, as small files have; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def valid_card(value: Column) -> Column:
    """Network prefix with its lengths, and the Luhn check."""
    d = F.regexp_replace(value, "[^0-9]", "")
    size, p = F.length(d), lambda n: F.substring(d, 1, n).cast("int")
    network = (
        (d.startswith("4") & size.isin(13, 16, 19))
        | (p(2).isin(34, 37) & (size == 15))
        | (p(2).between(51, 55) & (size == 16))
        | (p(4).between(2221, 2720) & (size == 16))
        | (((p(4) == 6011) | (p(2) == 65) | p(3).between(644, 649)) & size.between(16, 19))
    )
    return F.coalesce(network & F.call_function("luhn_check", d), F.lit(False))


def valid_ssn(value: Column) -> Column:
    d = F.regexp_replace(value, "[^0-9]", "")
    area = F.substring(d, 1, 3).cast("int")
    return (F.length(d) == 9) & (area > 0) & (area != 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def judged(matches: DataFrame, config: ScanConfig) -> DataFrame:
    """The candidates that stand, with type, confidence and environment; before overlaps are resolved."""
    value, radius = F.col("value"), config.context_window
    before = F.least("start", F.lit(radius))  # characters of `around` before the value
    rows = matches.withColumn("near", F.lower("around"))
    close = F.least(before, F.lit(12))
    rows = rows.withColumn("tight", F.substring("near", before - close + 1, close + F.length(value) + 12))
    rows = rows.where(~has_any(F.lower("value"), config.allowed()) & ~has_any(F.col("tight"), config.allowed()))
    is_rule, shaped = F.col("kind") == "rule", F.col("tier").isin(1, 2)
    rows = rows.withColumns({"contextual": has_any(F.col("near"), CONTEXT_WORDS), "bits": F.when(~shaped, entropy(value)).otherwise(F.lit(0.0))})
    passes = F.when(F.col("validator") == "credit_card", valid_card(value)).when(F.col("validator") == "ssn", valid_ssn(value)).otherwise(F.lit(True))
    gate = F.exists("words", lambda w: F.contains(F.col("near"), w))
    for r in config.every_rule():
        if r.context_regex:
            gate = gate | ((F.col("rule_id") == r.id) & F.col("around").rlike(r.context_regex))
    secretive = has_char_mix(value) & ~is_hash_or_uuid(value)
    shapeless = secretive & (F.col("bits") >= F.col("least_bits")) & gate
    worth = ~value.rlike(r"[()\s=]") & (has_any(F.col("key"), CONTEXT_WORDS) | ((F.length(value) >= 16) & has_char_mix(value) & (F.col("bits") >= 3.5)))
    blob = secretive & ~is_identifier(value) & (F.col("bits") >= config.entropy_threshold) & (F.col("contextual") | F.lit(not config.require_context_for_entropy))
    stands = F.when(is_rule & (F.col("tier") == 3), shapeless).when(is_rule, passes).when(F.col("kind") == "entropy", blob).otherwise(worth)
    if config.suppressed_rule_ids:
        stands = stands & ~F.col("rule_id").isin(*config.suppressed_rule_ids)
    base = F.col("base")
    raised = F.when(base == "low", "medium").otherwise("high")
    of_rule = F.when((F.col("tier") != 3) & (base != "high") & F.col("contextual"), raised).otherwise(base)
    of_assignment = F.when((F.col("bits") >= 4.0) & has_char_mix(value), "high").when(F.col("bits") < 3.0, "low").otherwise("medium")
    confidence = F.when(is_rule, of_rule).when(F.col("kind") == "entropy", F.when(F.col("contextual"), "medium").otherwise("low")).otherwise(of_assignment)
    prod, dev = has_any(F.col("near"), PROD_WORDS), has_any(F.col("near"), DEV_WORDS)
    found = rows.where(stands).withColumns(
        {
            "layer": F.when(is_rule, "known_pattern").otherwise(F.col("kind")),
            "type": F.when(is_rule, F.col("type")).when(F.col("kind") == "entropy", "high_entropy_string").otherwise("env_assignment"),
            "confidence": confidence,
            "environment": F.when(prod & ~dev, "prod").when(dev & ~prod, "dev").otherwise("unknown"),
            "reason": F.when(is_rule, F.concat(F.lit("Matches the rule "), F.col("rule_id"))).when(F.col("kind") == "entropy", "High-entropy string near a word for credentials").otherwise(F.concat(F.lit("Assignment to "), F.col("key"))),
            "mask_hint": F.nullif(F.col("mask_hint"), F.lit("")),
        }
    )
    return found.select("id", "seq", "layer", "type", "confidence", "start", "end", "value", "environment", "reason", "rule_id", "mask_hint")


def specificity(layer: Column, confidence: Column) -> Column:
    rank = lambda c, ranks: F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), c)
    return rank(layer, _LAYER_RANK) * 10 + rank(confidence, _CONFIDENCE_RANK)


def without_overlaps(found: DataFrame) -> DataFrame:
    """(id, findings): each text's findings in order.  A later one that clashes with the last kept takes its place only if it
    is more specific; as starts rise and kept spans don't touch, no other can clash.

    A finding that starts where all before it have ended can't clash with them, so each run of findings that touch is folded by
    itself and a text with very many findings costs no more for each of them."""
    order = Window.partitionBy("id").orderBy("start", F.col("end").desc(), "seq")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    runs = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    packed = F.struct("start", (-F.col("end")).alias("back"), "seq", specificity(F.col("layer"), F.col("confidence")).alias("rank"), F.struct("layer", "type", "confidence", "start", "end", "value", "environment", "reason", "rule_id", "mask_hint").alias("finding"))
    rows = runs.groupBy("id", "run").agg(F.array_sort(F.collect_list(packed)).alias("all"))

    def step(kept: Column, f: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        clash = (F.size(kept) > 0) & (last["finding"]["end"] > f["start"])
        swapped = F.when(f["rank"] > last["rank"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(f))).otherwise(kept)
        return F.when(clash, swapped).otherwise(F.concat(kept, F.array(f)))

    empty = F.filter("all", lambda f: F.lit(False))
    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", empty, step))
    folded = rows.select("id", "run", F.transform(kept, lambda f: f["finding"]).alias("findings"))
    whole = folded.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "findings"))).alias("runs"))
    return whole.select("id", F.flatten(F.transform("runs", lambda r: r["findings"])).alias("findings"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", config: ScanConfig | None = None) -> DataFrame:
    """(id, findings) of the texts that have findings.  Null and empty texts have none; `key` must be unique."""
    config = config or ScanConfig()
    return without_overlaps(judged(candidates(df, key, text, config), config))

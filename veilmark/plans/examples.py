"""Texts that rules must and must not find, made from the rules' own patterns, and the same judgement in SQL.

A token is drawn from a rule's pattern; near misses are the token cut short, with a mark inside, and with its case turned.
Whether they match is left to the SQL engine's own pattern matcher.
"""

from __future__ import annotations

import random
import re._constants as kinds
import re._parser as sre_parse

from veilmark.operators.config import ALLOWLIST
from veilmark.sources.rules import Rule, builtin_rules

#: Patterns that the SQL engine's matcher has no word for, in its own words; the value is the first group.
IN_SQL = {
    "aws.secret_access_key_contextual": r"(?:^|[^A-Za-z0-9/+])([A-Za-z0-9/+]{40})(?:$|[^A-Za-z0-9/+=])",
    "openai.api_key": r"\b(sk-(?:proj-)?[A-Za-z0-9\-_]{20,})\b",
    "pii.ssn_dashed": r"\b(\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})\b",
}
BEFORE, AFTER = ("the value ", "my token is "), (" at noon", "")


def drawn(pattern: str, rng: random.Random) -> str:
    """A string that `pattern` matches, apart from what stands around it."""
    groups: dict[int, str] = {}

    def one(items) -> str:
        letters: list[str] = []
        negated = items and items[0][0] is kinds.NEGATE
        for kind, value in items[1:] if negated else items:
            if kind is kinds.LITERAL:
                letters.append(chr(value))
            elif kind is kinds.RANGE:
                letters += [chr(c) for c in range(value[0], value[1] + 1)]
            elif kind is kinds.CATEGORY:
                letters += {kinds.CATEGORY_DIGIT: "0123456789", kinds.CATEGORY_SPACE: " ", kinds.CATEGORY_WORD: "abcXYZ019_"}.get(value, "x")
        letters = [c for c in "abcdefXYZ012789-_" if c not in letters] if negated else letters
        return rng.choice(letters)

    def of(parts) -> str:
        out = ""
        for kind, value in parts:
            if kind is kinds.LITERAL:
                out += chr(value)
            elif kind is kinds.NOT_LITERAL:
                out += rng.choice([c for c in "abc123" if c != chr(value)])
            elif kind is kinds.IN:
                out += one(value)
            elif kind is kinds.ANY:
                out += rng.choice("abc123")
            elif kind is kinds.BRANCH:
                out += of(rng.choice(value[1]))
            elif kind is kinds.SUBPATTERN:
                made = of(value[-1])
                groups[value[0]] = made
                out += made
            elif kind is kinds.GROUPREF:
                out += groups.get(value, "")
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
                least, most, inner = value
                out += "".join(of(inner) for _ in range(rng.randint(least, min(most, least + 3))))
        return out

    return of(sre_parse.parse(pattern))


def cases(seed: int = 9, variants: int = 3) -> list[tuple[int, str]]:
    """(case, text) for all rules but the card's, which has a query of its own."""
    rng, texts = random.Random(seed), []
    for rule in builtin_rules():
        if rule.validator == "credit_card":
            continue
        for v in range(variants):
            token = drawn(rule.regex, rng)
            middle = len(token) // 2
            hint = f"{rule.context[0]} " if rule.context and v == 0 else ""
            for made in (token, token[:-1], token[:middle] + "!" + token[middle + 1 :], token.swapcase()):
                texts.append(f"{rng.choice(BEFORE)}{hint}{made}{rng.choice(AFTER)}")
    return list(enumerate(texts))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_row(rule: Rule) -> str:
    own = IN_SQL.get(rule.id)
    pattern = own or rule.regex
    words = "[" + ", ".join(quoted(w.lower()) for w in rule.context) + "]::VARCHAR[]"
    return f"({quoted(rule.id)}, {quoted(('(?i)' if rule.ignore_case else '') + pattern)}, {1 if own else rule.group}, {rule.tier}, {quoted(rule.validator)}, {float(rule.entropy)}, {words}, {quoted(rule.context_regex)})"


def cases_sql() -> str:
    return ", ".join(f"({i}, {quoted(t)})" for i, t in cases())


def judged_sql(texts: str, radius: int = 64) -> str:
    """(id, rule_id, value, start) of the matches of all rules but the card's in `texts`, a query for (id, text)."""
    rules = [r for r in builtin_rules() if r.validator != "credit_card"]
    each = "\nUNION ALL ".join(
        f"SELECT id, text, {quoted(r.id)} AS rule_id, unnest(regexp_extract_all(text, {quoted(('(?i)' if r.ignore_case else '') + IN_SQL.get(r.id, r.regex))}, {1 if r.id in IN_SQL else r.group})) AS value FROM t" for r in rules
    )
    allowed = " OR ".join(f"contains({{0}}, {quoted(w)})" for w in ALLOWLIST)
    table = ", ".join(_rule_row(r) for r in rules)
    return f"""WITH t AS ({texts}), rules(rule_id, pattern, grp, tier, validator, least, words, near_pattern) AS (VALUES {table}),
found AS ({each}),
placed AS (SELECT *, position(value IN text) - 1 AS s FROM found WHERE value <> ''),
near AS (SELECT *, substr(text, greatest(s - {radius}, 0) + 1, s - greatest(s - {radius}, 0) + length(value) + {radius}) AS around, lower(substr(text, greatest(s - 12, 0) + 1, s - greatest(s - 12, 0) + length(value) + 12)) AS tight, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM placed JOIN rules USING (rule_id))
SELECT id, rule_id, value, CAST(s AS INTEGER) AS start FROM near
WHERE NOT (rule_id = 'openai.api_key' AND starts_with(value, 'sk-ant-')) AND NOT ({allowed.format('lower(value)')}) AND NOT ({allowed.format('tight')})
  AND (validator <> 'ssn' OR (length(d) = 9 AND left(d, 3) NOT IN ('000', '666') AND left(d, 1) <> '9' AND substr(d, 4, 2) <> '00' AND right(d, 4) <> '0000'))
  AND (tier <> 3 OR (CAST(regexp_matches(value, '[a-z]') AS INT) + CAST(regexp_matches(value, '[A-Z]') AS INT) + CAST(regexp_matches(value, '[0-9]') AS INT) >= 2
    AND NOT (regexp_full_match(value, '[0-9a-fA-F]+') AND length(value) IN (32, 40, 56, 64, 96, 128)) AND list_aggregate(string_split(value, ''), 'entropy') >= least - 1e-9
    AND (len(list_filter(words, lambda w: contains(lower(around), w))) > 0 OR (near_pattern <> '' AND regexp_matches(around, near_pattern)))))
"""

"""Manifests, imports, the incident sink, policies from elsewhere, patterns that are refused, lists of terms."""

import json
import random
import re
import time

import pytest

from veilmark.functions.ambiguity import ambiguity
from veilmark.functions.needles import Terms
from veilmark.operators.config import ScanConfig
from veilmark.operators.detect import Matcher, scan
from veilmark.operators.incidents import IncidentSink
from veilmark.operators.policy import decide
from veilmark.sources.manifests import ImportConfig, imports_masked, manifests, read_files
from veilmark.sources.policyfile import PolicyStore, load_policy, regex_risk

FILES = {
    "go.mod": "// c\nmodule acme.io/core\n\ngo 1.22\n",
    "jvm/pom.xml": "<project>\n<groupId> io.acme.pay </groupId></project>",
    "jvm/build.gradle": "group = 'io.other'",
    "gradle/build.gradle.kts": 'plugins {}\ngroup = "io.acme.kt"\n',
    "net/Acme.Billing.csproj": "<Project><RootNamespace>Acme.Web</RootNamespace></Project>",
    "net2/Fallback.App.csproj": "<Project/>",
    "py/pyproject.toml": '[project]\nname = "acme-tools"\n',
    "rs/Cargo.toml": "[package]\nname = 'acme-engine'\n",
    "bad/go.mod": "no module line",
    "bad/pyproject.toml": "\n",
    "src/main.py": "name = 'x'",
}


def test_manifests(spark, tmp_path):
    for path, content in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    got = {(r["project"].removeprefix(f"file:{tmp_path}").lstrip("/"), r["language"]): (r["prefix"], r["problem"]) for r in manifests(read_files(spark, str(tmp_path))).collect()}
    assert got == {
        ("", "go"): ("acme.io/core", None),
        ("jvm", "java"): ("io.acme.pay.", None),
        ("jvm", "kotlin"): ("io.acme.pay.", None),
        ("gradle", "java"): ("io.acme.kt.", None),
        ("gradle", "kotlin"): ("io.acme.kt.", None),
        ("net", "csharp"): ("Acme.", None),
        ("net2", "csharp"): ("Fallback.", None),
        ("py", "python"): ("acme_tools", None),
        ("rs", "rust"): ("acme_engine", None),
        ("bad", "go"): (None, "no name found in go.mod"),
        ("bad", "python"): (None, "no name found in pyproject.toml"),
    }
    odd = spark.createDataFrame([("go.mod", None), (None, "x"), ("a/other.txt", "x")], "path string, content string")
    assert [tuple(r) for r in manifests(odd).collect()] == [("", "go", None, "no name found in go.mod")]


def test_imports(spark):
    projects = spark.createDataFrame([("r", "go", "acme.io/root"), ("r/sub", "go", "acme.io/sub"), ("r/sub/none", "go", None), ("r", "python", "acme")], "project string, language string, prefix string")
    rows = [
        (1, "r/sub/x/f.go", "go", "acme.io/sub/pay", "Pay"), (2, "r/f.go", "go", "acme.io/sub/pay", "Pay"), (3, "r/sub/none/f.go", "go", "acme.io/sub", "S"),
        (4, "elsewhere/f.go", "go", "acme.io/root", "R"), (5, "r/sub/f.py", "python", "acme.x", "x"), (6, "r/f.ts", "ts", "../core/ledger/entry.js", "Ledger"),
        (7, "r/f.ts", "ts", "node:fs", "fs"), (8, "r/f.ts", "ts", "@own/x", "o"), (9, None, None, None, None), (10, "r/f.ts", "ts", "..", "up"), (11, "r/f.ts", "ts", ".", "here"),
    ]
    df = spark.createDataFrame(rows, "id int, path string, language string, module string, name string")
    got = {r["id"]: r for r in imports_masked(df, projects, ImportConfig("s", scopes=("@own/",))).collect()}
    assert {i: (r["origin"], r["project"]) for i, r in got.items()} == {
        1: ("internal", "r/sub"), 2: ("external", "r"), 3: ("internal", "r/sub"), 4: ("external", None), 5: ("internal", "r"), 6: ("relative", None),
        7: ("node", None), 8: ("internal", None), 9: (None, None), 10: ("relative", None), 11: ("relative", None),
    }
    assert re.fullmatch(r"\.\./mod_[0-9a-z]{6}\.js", got[6]["module_mask"]) and re.fullmatch("Import_[0-9a-z]{6}", got[6]["name_mask"])
    assert re.fullmatch(r"\.\./mod_[0-9a-z]{6}", got[10]["module_mask"]) and re.fullmatch(r"\./mod_[0-9a-z]{6}", got[11]["module_mask"])
    assert got[2]["module_mask"] is None and got[7]["name_mask"] is None and got[1]["module_mask"].startswith("./mod_")


def test_incident_sink(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, draw.choice([None, *range(20)]), draw.choice(["a", "b", None])) for i in range(120)]
    sink = IncidentSink(spark, str(tmp_path / "kept"), keep=5)
    assert sink.incidents() is None
    frames = [spark.createDataFrame(rows[n::4], "id long, timestamp long, site_id string") for n in range(4)]
    for n, again in ((0, False), (1, False), (1, True), (0, True), (2, False), (3, False), (3, True)):
        assert sink.add(frames[n], n) is not again
    want = {site: sorted((r for r in rows if r[2] == site), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))[-5:] for site in ("a", "b", None)}
    got = sorted((tuple(r) for r in sink.incidents().collect()), key=str)
    assert got == sorted((r for x in want.values() for r in x), key=str)
    (tmp_path / "kept" / f"{9:020d}").mkdir()  # a version that was never finished doesn't count
    assert sink.incidents().count() == len(got)


def test_policies_from_elsewhere(spark, tmp_path):
    good, better, bad = '{"version": 1, "blocklist": ["acme"]}', '{\n "version": 1,\r\n "blocklist": ["acme", "corp"]}', '{"version": 1, "paterns": []}'

    def down() -> str:
        raise OSError("no route")

    store = lambda fetch: PolicyStore(spark, str(tmp_path / "policies"), fetch)
    with pytest.raises(ValueError, match="can't be fetched"):
        store(down).load()
    policy, origin = store(lambda: good).load()
    assert origin == "fetched" and policy == load_policy(good)
    with pytest.raises(ValueError, match="'patterns' meant"):
        store(lambda: bad).load()
    assert store(down).load() == (load_policy(good), "kept")
    assert store(lambda: better).load()[0] == load_policy(better)
    assert store(lambda: better).load()[1] == "fetched" and store(down).kept() == better


@pytest.mark.parametrize("pattern", ["(a|a)*b", r"\s*x?\s*$", "(a+)+b", "(a|ab|b)*c", "a*a*b", ".*foo.*x", "[a-z]*[0-9]*[a-z]*$", "(x+x+)+y", "a{1,50}a{1,50}b", r"([^\n]*?)(?=\s#|\s*\n)", "(?:a?b?)*c", r"(\w+\s?)*;"])
def test_unsafe_patterns(pattern):
    assert ambiguity(pattern) and regex_risk(pattern)
    with pytest.raises(ValueError):
        load_policy(json.dumps({"version": 1, "patterns": [{"name": "x", "match": {"type": "regex", "advanced": True, "source": pattern}, "examples": {"match": ["a"]}}]}))


@pytest.mark.parametrize("pattern", [".*foo.*", "[a-z]+-[0-9]+", r"\w+\s*=\s*\w+;", "(?:ab)*c", r"\s*+x?\s*+$", "EMP-[0-9]{6}", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", r"\bacct-(?P<n>\d+)\b", r"(\w|\d)+;", "(?i)proj-[a-f]+(?:-[a-f]+)?!", "é+ü"])
def test_safe_patterns(pattern):
    assert ambiguity(pattern) == ""


def test_ten_thousand_terms(spark):
    text = "a long text without any of them " * 3000 + "Project-77-name."
    seconds = {}
    for n in (100, 10_000):
        policy = load_policy(json.dumps({"version": 1, "blocklist": [f"project-{i}-name" for i in range(n)]}))
        matcher = Matcher(ScanConfig(custom_rules=policy.rules, rules=()))
        began = time.time()
        for _ in range(20):
            found = [r for r in matcher.rows(text) if r[2] == "policy.blocklist"]
        seconds[n] = time.time() - began
        assert [(r[3], r[5]) for r in found] == [(len(text) - 16, "Project-77-name")]
    assert seconds[10_000] < 3 * seconds[100] + 0.2


def test_terms_are_those_of_the_pattern():
    draw = random.Random(1)
    for _ in range(2000):
        terms = ["".join(draw.choice("abB1.") for _ in range(draw.randint(1, 4))) for _ in range(draw.choice([2, 15]))]
        whole_word, ignore_case = draw.random() < 0.5, draw.random() < 0.5
        either = "|".join(map(re.escape, terms))
        pattern = re.compile(f"(?<![A-Za-z0-9])(?:{either})(?![A-Za-z0-9])" if whole_word else either, re.ASCII | (re.IGNORECASE if ignore_case else 0))
        text = "".join(draw.choice("aAbB1. ") for _ in range(20))
        assert list(Terms(terms, whole_word, ignore_case).spans(text)) == [m.span() for m in pattern.finditer(text)]


def test_list_and_regex_policies(spark):
    document = {"version": 1, "patterns": [
        {"name": "Plant", "match": {"type": "list", "terms": ["Aalen", "Ulm"], "wholeWord": True}, "examples": {"match": ["in Ulm"], "noMatch": ["ulm", "Ulmer"]}},
        {"name": "Ticket", "action": "block", "match": {"type": "regex", "advanced": True, "source": "TK-[0-9]{4,6}", "flags": "i"}, "examples": {"match": ["tk-1234"]}},
    ]}
    config = load_policy(json.dumps(document)).scan_config()
    df = spark.createDataFrame([(1, "Ulm and Ulmer, tk-12345"), (2, "Aalen"), (3, "aalen TK-1")], "id int, text string")
    got = {r["id"]: (r["action"], [(f["rule_id"], f["value"]) for f in r["findings"]]) for r in decide(scan(df, "id", "text", config), config).collect()}
    assert got == {1: ("block", [("policy.plant", "Ulm"), ("policy.ticket", "tk-12345")]), 2: ("warn", [("policy.plant", "Aalen")])}

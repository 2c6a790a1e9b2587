"""Requests made safe from end to end, and the registry of stand-ins."""

import itertools
import json
import random

import pyarrow as pa
import pytest

from veilmark.operators.registry import SessionRegistry
from veilmark.operators.requests import protect_requests, protect_requests_as, survives
from veilmark.sources.policyfile import load_policy
from veilmark.sources.settings import Settings, languages
from veilmark.sources.wire import request_texts, written_back

KEY = "AKIA" + "Z7Q2" * 4
OTHER = "AKIA" + "B3C4" * 4
ENV = "CITY=Oslo-town\nTOKEN=\"" + KEY + '"'


def bodies(text, tool, extra):
    return {
        "anthropic": {"system": "rules", "n": extra, "messages": [{"role": "user", "content": text}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": extra, "content": tool}]}]},
        "openai": {"messages": [{"role": "user", "content": [{"type": "text", "text": text}]}, {"role": "tool", "tool_call_id": extra, "content": tool}]},
        "responses": {"input": [{"role": "user", "content": text}, {"type": "function_call_output", "call_id": extra, "output": tool}]},
        "gemini": {"contents": [{"parts": [{"text": text}, {"functionResponse": {"id": extra, "response": {"deep": [{"x": tool}]}}}]}]},
    }


@pytest.mark.parametrize("shape", ["anthropic", "openai", "responses", "gemini"])
def test_requests(spark, shape):
    make = lambda *x: json.dumps(bodies(*x)[shape])
    rows = [
        (1, make(f"use {KEY} and {OTHER}", f"got {KEY}", "call-1")),
        (2, make(ENV, "fine", "call-2")),
        (3, make("plain words", "fine", "call-3")),
        (4, make(f"use {KEY}", "fine", f"id-{KEY}")),  # in an id, which no pass touches
        (5, make(f"use {KEY}", "fine", "call").replace('"call"', '"\\u0041' + KEY[1:] + '"')),  # and with an escape
        (6, "no json " + KEY), (7, None), (8, "[1]"), (None, make(f"use {KEY}", "x", "y")),
    ]
    df = spark.createDataFrame(rows, "id int, body string")
    got = {r["id"]: r for r in protect_requests(df, "id", "body", shape, "salt", directive="NOTE").collect()}
    assert set(got) == {r[0] for r in rows}
    for i in (1, 2, None):
        assert KEY not in got[i]["body"] and got[i]["body"].count("NOTE") == 1 and got[i]["changed"] and not got[i]["blocked"]
        back = got[i]["body"]
        for m in sorted(got[i]["mocks"], key=lambda m: -len(m["mock"])):
            back = back.replace(m["mock"], json.dumps(m["real"])[1:-1])
        assert json.loads(back.replace("NOTE", "")) != json.loads(got[i]["body"]) and all(t in back for t in ("VEILMARK",)[:0])
        original = json.loads(dict(rows)[i])
        assert str(original).count(KEY) == back.count(KEY)
    assert "Oslo" not in got[2]["body"] and got[2]["env_blocks"] == 1 and got[1]["n_secrets"] == 3
    mocks = {m["real"]: m["mock"] for m in got[1]["mocks"]}
    assert got[1]["body"].count(mocks[KEY]) == 2 and got[1]["body"].count(mocks[OTHER]) == 1
    for i in (3, 6, 7, 8):
        assert (got[i]["body"], got[i]["changed"], got[i]["leaked"], got[i]["blocked"]) == (dict(rows)[i], False, False, False)
    for i in (4, 5):
        assert got[i]["leaked"] and got[i]["blocked"] and got[i]["body"] is None
    if shape != "openai":
        return
    blocked = {r["id"]: r for r in protect_requests(df.where("id in (1, 3)"), "id", "body", shape, "salt", on_detect="block").collect()}
    assert blocked[1]["blocked"] and blocked[1]["body"] is None and not blocked[3]["blocked"]
    assert protect_requests(df.limit(0), "id", "body", shape, "salt").count() == 0


def test_settings():
    assert Settings.read({}) == Settings() and Settings.read({"VEILMARK_MASK_ENV": "", "OTHER": "x"}) == Settings()
    made = Settings.read({"VEILMARK_ON_DETECT": "Block", "VEILMARK_MASK_ENV": "off", "VEILMARK_MASK_MEMBERS": "YES", "VEILMARK_LANGUAGES": "go, cobol", "VEILMARK_SQL_DIALECT": "mysql"}, "s")
    assert (made.on_detect, made.mask_env, made.mask_members, made.languages, made.sql_dialect, made.infra.salt) == ("block", False, True, ("go", "cobol"), "mysql", "s")
    with pytest.raises(ValueError, match="ON_DETECT.*SQL_DIALECT.*LANGUAGES"):
        Settings.read({"VEILMARK_ON_DETECT": "bock", "VEILMARK_SQL_DIALECT": "x", "VEILMARK_LANGUAGES": "klingon"})
    assert languages(["all", "none"]) == () and languages(["defaults", "cobol"]) == (*languages(["defaults"]), "cobol")
    policy = load_policy(json.dumps({"version": 1, "languages": ["none"], "internalDomains": ["acme.io"], "internalTlds": ["zone"], "internalScopes": ["@acme/*"], "internalPackagePrefixes": {"go": ["a", "b"]}, "policy": {"sql": False, "fileReads": False, "pii": {"ssn": False}}}))
    laid = made.under(policy).under(policy)
    assert (laid.mask_sql, laid.mask_tool_results, laid.mask_members, laid.languages, laid.scopes) == (False, False, True, (), ("@acme/", "@acme/"))
    assert dict(laid.prefixes) == {"go": ("a", "b")} and laid.infra.domains == ("acme.io", "acme.io") and "zone" in laid.infra.labels and "pii.ssn_dashed" in laid.scan.suppressed_rule_ids


def test_settings_are_obeyed(spark):
    body = json.dumps(bodies(ENV, f"got {OTHER}", "x")["openai"])
    df = spark.createDataFrame([(1, body)], "id int, body string")
    run = lambda s: protect_requests_as(df, "id", "body", "openai", "salt", s, "NOTE").first()
    whole, bare = run(Settings()), run(Settings(mask_env=False, mask_tool_results=False, directive=False))
    assert OTHER not in whole["body"] and "Oslo" not in whole["body"] and "NOTE" in whole["body"] and whole["env_blocks"] == 1
    assert OTHER in bare["body"] and "Oslo" in bare["body"] and KEY not in bare["body"] and "NOTE" not in bare["body"] and bare["env_blocks"] == 0
    assert run(Settings(on_detect="block"))["body"] is None


def test_survives():
    assert survives('{"a": ["x secret-1."]}', ["secret-1"]) and survives('{"secret-1": 1}', ["secret-1"])
    assert survives('{"a": "\\u0073ecret-1"}', ["secret-1"]) and survives("no json secret-1", ["secret-1"])
    assert not survives('{"a": "xsecret-1"}', ["secret-1"]) and not survives('{"a": "1"}', ["1"]) and not survives('{"a": "b"}', [])
    assert survives('{"a": "line\\nbreak"}', ["line\nbreak"]) and survives('{"a": "é"}', ["é", "nothing"]) is False


def plain(batches):
    out = {}
    for name in sorted(batches):
        for session, mock, real in sorted(batches[name], key=str):
            if mock and (session, mock) not in out:
                out[session, mock] = real
    return out


def test_registry(spark, tmp_path):
    """Batches in every order, some twice, with compactions between: one table, that of the earliest batch and least value."""
    draw = random.Random(7)
    batches = {f"b{n}": [(draw.choice(["s", "t", None]), draw.choice(["m1", "m2", "m3", "", None]), f"r{draw.randint(0, 5)}") for _ in range(8)] for n in range(3)}
    frames = {n: spark.createDataFrame(rows, "session string, mock string, real string").coalesce(1) for n, rows in batches.items()}
    want = plain(batches)
    for n, order in enumerate([*itertools.permutations(batches)][1::3]):
        registry = SessionRegistry(spark, str(tmp_path / str(n)))
        assert registry.pairs().count() == 0
        for i, name in enumerate(order):
            assert registry.add_pairs(name, frames[name]) and not registry.add_pairs(name, frames[name])
            if i == n % 3:
                registry.compact()
                assert not registry.add_pairs(name, frames[name])
        got = {(r["session"], r["mock"]): r["real"] for r in registry.pairs().collect()}
        assert got == want
    (tmp_path / "0" / "batches" / "b9").mkdir()  # a batch that was never finished doesn't count
    assert SessionRegistry(spark, str(tmp_path / "0")).pairs().count() == len(want)


def test_registry_as_a_sink(spark, tmp_path):
    rows = [("s", f"m{n % 3}", f"r{n}") for n in range(6)]
    for n in range(3):
        spark.createDataFrame(rows[2 * n : 2 * n + 2], "session string, mock string, real string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("session string, mock string, real string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    registry = SessionRegistry(spark, str(tmp_path / "registry"))
    query = source.writeStream.foreachBatch(registry.sink()).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    got = {r["mock"]: r["real"] for r in registry.pairs().collect()}
    assert got == {"m0": "r0", "m1": "r1", "m2": "r2"}
    registry.sink()(spark.createDataFrame([("s", "m0", "late")], "session string, mock string, real string"), 0)  # a batch that comes again
    assert {r["mock"]: r["real"] for r in registry.pairs().collect()} == got


def test_python_is_handed_small_batches(spark):
    """A worker held ten thousand bodies and all their texts at once."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "10000")
        bodies = spark.range(3000).selectExpr("id", """'{"messages":[{"role":"user","content":"hi"}]}' AS body""")
        texts = request_texts(bodies, "id", "body", "anthropic")
        sizes = texts.select("id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert texts.count() == 3000 and max(r["n"] for r in sizes.collect()) <= 1000
        assert written_back(bodies, "id", "body", "anthropic", texts).where("body like '%hi%'").count() == 3000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_bodies_are_read_once(spark):
    """Source rows go once to the texts and once to the bodies that are written; before, each branch read the bodies' texts anew."""
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return (n if n else None, json.dumps({"messages": [{"role": "user", "content": f"use AKIA{n:016d} here" if n % 2 else "plain"}]}) if n % 5 else None)

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(20), 2).map(counted), "id int, body string")
    got = {r["id"]: r for r in protect_requests(df, "id", "body", "anthropic", "salt").collect()}
    assert set(got) == {None, *range(1, 20)} and seen.value == 40
    for n in range(1, 20):
        row = got[n]
        masked = n % 2 == 1 and n % 5 > 0
        assert row["changed"] == masked and [m["real"] for m in row["mocks"]] == ([f"AKIA{n:016d}"] if masked else []) and row["n_secrets"] == masked
        assert row["body"] is None if n % 5 == 0 else (row["mocks"][0]["mock"] in row["body"] if masked else row["body"] == json.dumps({"messages": [{"role": "user", "content": "plain"}]}))

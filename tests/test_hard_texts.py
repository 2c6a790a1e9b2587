"""Texts and bodies that used to end or stall a job."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from veilmark.operators.detect import scan
from veilmark.operators.envfile import env_blocks_masked, mask_env, value_spans
from veilmark.operators.infra import InfraConfig, mask_infra
from veilmark.operators.transform import redact, rehydrate, splice
from veilmark.sources.wire import FORMATS, request_texts, written_back

# The plain form of a value, which takes quadratic time on white space.
PLAIN = (
    r"(?<![^\n])([^\S\n]*(?:export[^\S\n]+)?[A-Za-z_][A-Za-z0-9_]*[^\S\n]*=[ \t]*)"
    r"(?:\"(?!\")([^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+)\"([^\n]*)|'([^']+)'([^\n]*)|([^\s'\"](?:[^\n]*?))(?=\s#|\s*(?:\n|(?![\s\S]))))"
)


def took(work):
    began = time.time()
    work()
    return time.time() - began


def test_values_are_those_of_the_plain_pattern():
    draw = random.Random(8)
    pieces = ["A=", "export B = ", "x", '"', "'", "\\", " ", "  ", "\t", "#", " #", "\n", "=", "é", "y z", "\r\n", "C='d'", 'D="e\\"f" # g', "\x0b"]
    for _ in range(20000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 10)))
        want = [next(m.span(g) for g in (2, 4, 6) if m[g]) for m in re.finditer(PLAIN, text, re.ASCII)]
        assert value_spans(text) == want, text


def test_env_texts_in_linear_time(spark):
    n = 1_000_000
    texts = ["A=x\nB=y\nC=z" + " " * n + "w\nD=1", "A=x\nB=" + " #" * (n // 2), 'A="' + "\\n" * (n // 2) + '"\nB=2', 'A=1\nB="' + "x" * n, "`" * n, "```a\n" * (n // 5), "```\nA=1\nB=2\n```" + "`" * n, "A=" + "word " * (n // 5) + "\nB=2"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    mask_env(df.limit(1), "id", "text", "s").collect()
    rows = {}
    assert took(lambda: rows.update({r["id"]: r["m"] for r in df.select("id", env_blocks_masked(F.col("text"), "s").alias("m")).collect()})) < 40
    for i, text in enumerate(texts):
        back = rows[i]["masked"]
        for m in rows[i]["mocks"]:
            back = back.replace(m["mock"], m["real"])
        assert back == text, i
    assert [rows[i]["blocks"] for i in (0, 2, 4, 6)] == [1, 1, 0, 1]


def test_many_findings_in_one_text(spark):
    n = 100_000
    text = " ".join(f"AKIA{i:016d}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "none"), (3, f"é AKIA{7:016d} 𝒳")], "id int, text string")
    found = scan(df, "id", "text")
    redacted = df.join(found, "id").select("id", F.size("findings").alias("n"), redact(F.col("text"), F.col("findings")).alias("text"))
    got = {}
    assert took(lambda: got.update({r["id"]: r for r in redacted.collect()})) < 40
    assert got[1]["n"] == n and got[1]["text"] == " ".join(["[REDACTED_AWS_ACCESS_KEY]"] * n) and got[3]["text"] == "é [REDACTED_AWS_ACCESS_KEY] 𝒳"


def test_splice(spark):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(draw.choice("aé𝒳 ") for _ in range(draw.choice([0, 5, 400])))
        cuts = sorted(draw.sample(range(len(text) + 1), min(len(text) + 1, draw.choice([0, 2, 300]) // 2 * 2)))
        pieces = [(a, b, f"<{a}>") for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((i, text, draw.sample(pieces, len(pieces))))
    df = spark.createDataFrame(rows, "id int, text string, pieces array<struct<start:int,end:int,new:string>>")
    got = {r["id"]: r["out"] for r in df.select("id", splice(F.col("text"), F.col("pieces")).alias("out")).collect()}
    for i, text, pieces in rows:
        want = text
        for a, b, new in sorted(pieces, reverse=True):
            want = want[:a] + new + want[b:]
        assert got[i] == want


def test_odd_bodies(spark):
    """Lone halves of surrogate pairs, deep nesting, numbers that don't fit, repeated names, and no JSON at all."""
    deep = '{"messages":[{"role":"user","content":"change me"}],"x":' + "[" * 200_000 + "]" * 200_000 + "}"
    bodies = [
        '{"messages": [{"role":"user","content":"half \\ud83d here"}, {"role":"user","content":"change me"}],  "n": 1e400, "m": 1.10, "m": 1.20}',
        deep, "[" * 200_000, '{"messages": "text"}', "nan", "", None, '{"messages":[{"role":"user","content":"change me"}', '{"a": 00}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    texts = request_texts(df, "id", "body", "openai")
    found = sorted((r["id"], r["text"]) for r in texts.collect())
    assert found == [(0, "change me"), (0, "half \ufffd here"), (1, "change me")]
    changed = texts.where("text = 'change me'").withColumn("text", F.lit('new "é"'))
    out = {r["id"]: r["body"] for r in written_back(df, "id", "body", "openai", changed, "note").collect()}
    assert out[0] == '{"messages": [{"role":"system","content":"note"},{"role":"user","content":"half \\ud83d here"}, {"role":"user","content":"new \\"é\\""}],  "n": 1e400, "m": 1.10, "m": 1.20}'
    assert out[1] == deep.replace('[{"role"', '[{"role":"system","content":"note"},{"role"').replace("change me", 'new \\"é\\"')
    assert all(out[i] == bodies[i] for i in range(2, len(bodies)))


def test_directives_where_there_is_none_yet(spark):
    bodies = {
        "anthropic": ['{"messages":[{"role":"user","content":"a"}]}', '{"system":null,"messages":[{"role":"user","content":"a"}]}', '{"system":"a","messages":[]}'],
        "responses": ['{"input":"a"}', '{"instructions":"a","input":"b"}'],
        "gemini": ['{"contents":[{"parts":[{"text":"a"}]}]}', '{"system_instruction":{"parts":[{"text":"x"}]},"contents":[{"parts":[{"text":"a"}]}]}', '{"systemInstruction":{},"contents":[{"parts":[{"text":"a"}]}]}'],
        "openai": ['{"messages":[{"role":"developer","content":"a"}]}', '{"messages":[{"role":"system","content":[{"type":"text","text":"a"}]}]}'],
    }
    for shape, each in bodies.items():
        df = spark.createDataFrame(list(enumerate(each)), "id int, body string")
        texts = request_texts(df, "id", "body", shape)
        out = written_back(df, "id", "body", shape, texts.where("text = 'a'").withColumn("text", F.lit("A")), "NOTE")
        got = {r["id"]: json.loads(r["body"]) for r in out.collect()}
        for body in got.values():
            assert json.dumps(body).count("NOTE") == 1 and '"A' in json.dumps(body), (shape, body)
    assert set(bodies) == set(FORMATS)


def test_hosts_in_sentences(spark):
    texts = ["ssh db1.corp.internal. Then", "db1.corp.internal- up", "db1.internal-x.com", "db1.internals.example.com", "(db1.corp.internal)", "db1.corp.internal...", "a." * 300_000 + "internal", "x" * 500_000 + ".internal"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["m"] for r in df.select("id", mask_infra(F.col("text"), InfraConfig("s")).alias("m")).orderBy("id").collect()]
    shape = [re.sub(r"host-[0-9a-z]{6}", "H", x) for x in got]
    assert shape[:6] == ["ssh H.internal. Then", "H.internal- up", texts[2], texts[3], "(H.internal)", "H.internal..."]
    assert got[6] == texts[6] and shape[7] == "H.internal"


def test_rehydrate_with_many_stand_ins(spark):
    df = spark.createDataFrame([("b m1 m10", [("m1", "x"), ("m10", "y")])], "text string, mocks array<struct<mock:string,real:string>>")
    assert df.select(rehydrate(F.col("text"), F.col("mocks"))).first()[0] == "b x y"

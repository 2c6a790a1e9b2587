"""Stand-ins for names and literals."""

import hashlib

from pyspark.sql import functions as F

from veilmark.operators.names import FEW, NameConfig, concept_words, echoes, mask_alias, name_masks, name_words, scrub_literals


def short(text: str, salt: str = "") -> str:
    n, out = int(hashlib.sha256(f"{salt}:{text}".encode()).hexdigest()[:16], 16), ""
    while n:
        n, digit = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
    return out.rjust(6, "0")[:6]


def test_words(spark):
    rows = spark.createDataFrame([("mart_ghostJobIndex",), ("",), (None,), ("__A  b",), ("HTTPServer",)], "name string")
    got = [tuple(r) for r in rows.select(name_words(F.col("name")), concept_words(F.col("name"), NameConfig())).collect()]
    assert got == [(["mart", "ghost", "job", "index"], ["ghost"]), ([], []), (None, None), (["a", "b"], []), (["httpserver"], ["httpserver"])]


def test_aliases(spark):
    row = spark.range(1).select(*[
        mask_alias(F.lit("Ghostly_GHOST"), F.array(F.lit("ghost"), F.lit("ghostly")), NameConfig()),
        mask_alias(F.lit("plain"), F.array(F.lit("ghost")), NameConfig()),
        mask_alias(F.lit(r"a.b\E*c"), F.array(F.lit(r"b\E*")), NameConfig()),
        echoes(F.lit("MyGhost"), F.array(F.lit("ghost"))),
        echoes(F.lit("MyGhost"), F.array().cast("array<string>")),
    ]).first()
    assert list(row) == [f"c{short('ghostly')}_c{short('ghost')}", f"alias_{short('plain')}", f"a.c{short(chr(98) + chr(92) + 'E*')}c", True, False]


def test_masks_by_scope(spark):
    """Concepts count in their own scope; masked columns bring further concepts to aliases; repeats and odd rows."""
    rows = [
        ("s", "table", "raw_acmecorp"), ("s", "table", "raw_acmecorp"), ("s", "column", "acmecorp_rate"), ("s", "column", "AcmecorpNovel"), ("s", "alias", "novel_ids"),
        ("s", "column", "created_at"), ("s", "column", "payroll"), ("s", "alias", "my_payroll"), ("s", "alias", "abc"), ("s", "alias", ""), ("t", "column", "acmecorp_rate"),
        (None, "table", "x"), ("s", "table", None), ("s", "other", "acmecorp"), ("t", "schema", "zulu"), ("t", "table", "dim"),
    ]
    config = NameConfig(salt="k", columns=("payroll",))
    names = spark.createDataFrame(rows, "scope string, kind string, name string").withColumn("mask", F.lit("an own column")).withColumn("concepts", F.lit(1))
    got = {(r["scope"], r["kind"], r["name"]): r["mask"] for r in name_masks(names, config).collect()}
    h = lambda x: short(x, "k")
    assert got == {
        ("s", "table", "raw_acmecorp"): f"raw_{h('raw_acmecorp')}", ("s", "column", "acmecorp_rate"): f"{h('acmecorp_rate')}_rate", ("s", "column", "AcmecorpNovel"): f"col_{h('AcmecorpNovel')}",
        ("s", "alias", "novel_ids"): f"c{h('novel')}_ids", ("s", "column", "created_at"): None, ("s", "column", "payroll"): f"col_{h('payroll')}", ("s", "alias", "my_payroll"): f"my_c{h('payroll')}",
        ("s", "alias", "abc"): None, ("s", "alias", ""): None, ("t", "column", "acmecorp_rate"): None, ("t", "schema", "zulu"): f"schema_{h('zulu')}", ("t", "table", "dim"): f"dim_{h('dim')}",
    }
    assert name_masks(names.limit(0), config).count() == 0


def test_literals(spark):
    key = "AKIA" + "Z7Q2" * 4
    values = spark.createDataFrame([("At ACME today",), ("At ACME today",), ("123-45-6789",), (f"{key} and {key}",), ("plain",), ("",), (None,)], "value string")
    out = scrub_literals(values, NameConfig(blocked=("", "acme"), value_patterns=(r"^\d{3}-\d{2}-\d{4}$",)))
    got = {r["value"]: r for r in out.collect()}
    assert set(got) == {"At ACME today", "123-45-6789", f"{key} and {key}"}
    assert got["At ACME today"]["mask"] == f"veilmark_blocked_{short('At ACME today')}"
    assert got["123-45-6789"]["mask"] == f"veilmark_redacted_{short('123-45-6789')}"
    secret = got[f"{key} and {key}"]
    assert key not in secret["mask"] and [m["real"] for m in secret["mocks"]] == [key]
    assert secret["mask"] == f"{secret['mocks'][0]['mock']} and {secret['mocks'][0]['mock']}"


def test_names_are_worked_out_once(spark):
    """However many branches need names, their rows are read once; before, each branch read them anew."""
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    rows = [(n, kind, f"{word}{n}_x") for n in range(20) for kind, word in (("table", "ghost"), ("column", "ghost"), ("column", "novel"), ("alias", "my_ghost"))]
    names = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "scope int, kind string, name string")
    assert sum(r["mask"] is not None for r in name_masks(names, NameConfig()).collect()) == 60
    assert seen.value == len(rows)


def test_scopes_with_many_concepts(spark):
    """Scopes on both sides of FEW find the same: here by brute force."""
    rows = [(scope, "table", f"raw_word{n}") for scope, size in (("small", 5), ("edge", FEW), ("large", 3 * FEW)) for n in range(size)]
    rows += [(scope, kind, f"{name}{n}") for scope in ("small", "edge", "large", "none") for kind, name in (("alias", "myWord"), ("column", "plain_WORD")) for n in (3, 40, 190, 500)]
    got = {(r["scope"], r["kind"], r["name"]): r["mask"] for r in name_masks(spark.createDataFrame(rows, "scope string, kind string, name string"), NameConfig()).collect()}
    assert set(got) == set(rows)
    holds = lambda r, concepts: any(s == r[0] and c in r[2].lower() for s, c in concepts)
    concepts = {(scope, f"word{name[8:]}") for scope, kind, name in rows if kind == "table"}
    columns = {r for r in rows if r[1] == "column" and holds(r, concepts)}
    concepts |= {(r[0], w) for r in columns for w in r[2].lower().split("_")}
    assert {k for k, mask in got.items() if mask is not None} == columns | {r for r in rows if r[1] == "table" or r[1] == "alias" and holds(r, concepts)}
    assert got["large", "alias", "myWord190"] == f"myc{short('word190')}" and got["small", "alias", "myWord40"] is not None and got["none", "alias", "myWord3"] is None

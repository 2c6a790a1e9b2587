"""Whole texts made safe."""

import pytest
from pyspark.sql import functions as F

from veilmark.functions.text import base36_tag
from veilmark.operators.envfile import env_blocks_masked, mask_env
from veilmark.operators.protect import protect
from veilmark.operators.transform import rehydrate

ENV = "CITY=Oslo\nNAME='a b'\n# note\nPORT=80 # web"
KEY = "AKIA" + "Z7Q2" * 4


def test_blocks(spark):
    texts = [ENV, f"see\n```env\n{ENV}\n```\nand\n```\nx = f(y);\n```", "```\nunclosed\nA=1\nB=2", "``` ```", "", None, f"```\n{ENV}\n``` ```sh\n{ENV}\n```", f"{ENV}\n```\nplain\n```"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r["e"] for r in df.select("id", env_blocks_masked(F.col("text"), "salt").alias("e")).orderBy("id").collect()]
    (masked,) = [r["masked"] for r in mask_env(df.where("id = 0"), "id", "text", "salt").collect()]
    assert "Oslo" not in masked and "# note" in masked and "# web" in masked
    want = [(1, masked), (1, f"see\n```env\n{masked}\n```\nand\n```\nx = f(y);\n```"), (0, texts[2]), (0, texts[3]), (0, ""), (0, None), (2, f"```\n{masked}\n``` ```sh\n{masked}\n```"), (0, texts[7])]
    assert [(e["blocks"], e["masked"]) for e in got[:5] + got[6:]] == want[:5] + want[6:]
    assert got[5] is None or got[5]["masked"] is None
    assert sorted(m["real"] for m in got[6]["mocks"]) == ["80", "Oslo", "a b"]


def test_protect(spark):
    """Repeated texts and keys, nulls, stand-ins that are there already, values that stay elsewhere, an empty table."""
    rows = [(1, f"key {KEY}"), (2, f"key {KEY}"), (2, "again"), (None, f"key {KEY}"), (4, None), (5, ""), (6, f"Oslo is\n```\n{ENV}\n```"), (7, "VEILMARK_MOCK_AWS_ACCESS_KEY_ABCDEFGHIJKL"), (8, "long " * 40_000 + KEY)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("masked", F.lit(1)).withColumn("content", F.lit("c"))
    out = protect(df, "id", "text", "salt")
    got = out.select("*", rehydrate(F.col("masked"), F.col("mocks")).alias("back")).collect()
    tag = spark.range(1).select(F.upper(base36_tag(F.lit(f"{KEY}::salt"), 12))).first()[0]
    swapped = f"key VEILMARK_MOCK_AWS_ACCESS_KEY_{tag}"
    assert sorted(((r["id"] or 0, r["back"]) for r in got)) == sorted((i or 0, t) for i, t in rows if t is not None)
    by_id = {r["id"]: r for r in got if r["masked"] != "again"}
    assert [by_id[i]["masked"] for i in (1, 2, None)] == [swapped] * 3
    assert by_id[6]["leaked"] and by_id[6]["env_blocks"] == 1 and not by_id[1]["leaked"]
    assert by_id[7]["masked"] == rows[7][1] and by_id[7]["n_secrets"] == 0
    assert by_id[8]["masked"] == "long " * 40_000 + swapped.removeprefix("key ")
    blocked = {r["id"]: (r["blocked"], r["masked"]) for r in protect(df.where("id in (1, 5, 6)"), "id", "text", "salt", on_detect="block").collect()}
    assert blocked[1] == (True, None) and blocked[5] == (False, "") and not blocked[6][0]
    assert protect(df.limit(0), "id", "text", "salt").count() == 0
    with pytest.raises(ValueError):
        protect(df, "id", "text", "salt", on_detect="other")

"""Query of whole texts made safe, over texts made from customers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.protect import protect
from veilmark.operators.transform import rehydrate
from veilmark.plans.derived import derived, tag_sql

_KEY = "'AKIA' || upper(substr(md5(cast(c_custkey % 97 AS varchar(20))), 1, 16))"
_TEXTS = """SELECT c_custkey AS id, c_custkey % 5 AS kind, CASE c_custkey % 5
  WHEN 0 THEN 'My settings:' || chr(10) || '```env' || chr(10) || 'CITY=value' || cast(c_custkey % 97 AS varchar(20)) || chr(10) || 'SEGMENT="{s}"' || chr(10) || '```' || chr(10) || 'and {k} too' || chr(10) || '```' || chr(10) || 'plain words' || chr(10) || '```'
  WHEN 1 THEN 'CITY=value' || cast(c_custkey % 97 AS varchar(20)) || chr(10) || 'SEGMENT={s}' WHEN 2 THEN 'use {k} or {k} now' WHEN 3 THEN '' ELSE 'nothing in ' || c_mktsegment END AS text FROM customer"""
TEXTS = _TEXTS.replace("{s}", "' || c_mktsegment || '").replace("{k}", f"' || {_KEY} || '")


def texts_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "customer", TEXTS)
    out = protect(rows, "id", "text", "salt").join(rows, "id")
    return out.select("id", "masked", "env_blocks", "n_secrets", "leaked", (rehydrate(F.col("masked"), F.col("mocks")) == F.col("text")).alias("comes_back"))


def oracle_sql() -> dict[str, str]:
    env = lambda x: f"'VEILMARK_MOCK_ENV_' || upper({tag_sql(x, 6)})"
    mocked = f"SELECT *, {env('city')} AS city_mock, {env('segment')} AS segment_mock, 'VEILMARK_MOCK_AWS_ACCESS_KEY_' || upper({tag_sql('key', 12)}) AS key_mock FROM t JOIN (SELECT c_custkey AS id, 'value' || cast(c_custkey % 97 AS varchar(20)) AS city, c_mktsegment AS segment, {_KEY} AS key FROM customer) USING (id)"
    fenced = "'My settings:' || chr(10) || '```env' || chr(10) || 'CITY=' || city_mock || chr(10) || 'SEGMENT=\"' || segment_mock || '\"' || chr(10) || '```' || chr(10) || 'and ' || key_mock || ' too' || chr(10) || '```' || chr(10) || 'plain words' || chr(10) || '```'"
    return {
        "texts_protected": f"""WITH t AS ({TEXTS}), m AS ({mocked}) SELECT id, CASE kind WHEN 0 THEN {fenced} WHEN 1 THEN 'CITY=' || city_mock || chr(10) || 'SEGMENT=' || segment_mock WHEN 2 THEN 'use ' || key_mock || ' or ' || key_mock || ' now' ELSE text END AS masked,
          CAST(kind < 2 AS INTEGER) AS env_blocks, CAST(kind IN (0, 2) AS INTEGER) AS n_secrets, false AS leaked, true AS comes_back FROM m WHERE text IS NOT NULL"""
    }


def queries() -> dict:
    return {"texts_protected": texts_protected}

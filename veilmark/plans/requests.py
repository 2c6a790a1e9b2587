"""Queries of request bodies made safe and of the registry of stand-ins, and the same in SQL, hashes included."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.registry import SessionRegistry
from veilmark.operators.requests import protect_requests
from veilmark.operators.shared import shared_folder, written
from veilmark.plans.derived import derived, table, tag_sql
from veilmark.sources.wire import FORMATS, request_texts

_ID = "concat(cast(conv_id AS varchar(20)), '-', cast(turn AS varchar(20)))"
#: Of each message a request with its text and a tool's result: an environment block, a key in the text, nothing, a key that is in
#: the call's id too (which no pass may change), a key in the result.
TEXTS = f"""SELECT id, k, key, city, CASE k WHEN 0 THEN concat('my settings:', chr(10), '```env', chr(10), 'CITY=', city, chr(10), 'PASS="', key, '"', chr(10), '```', chr(10), t)
  WHEN 1 THEN concat('use ', key, ' here. ', t) WHEN 3 THEN concat('key ', key, ' ', t) ELSE t END AS said, CASE WHEN k = 4 THEN concat('got ', key, '.') ELSE 'fine' END AS told,
  CASE WHEN k = 3 THEN concat('call ', key) ELSE 'call 1' END AS call
  FROM (SELECT {_ID} AS id, length(coalesce(text, '')) % 5 AS k, coalesce(text, '') AS t, concat('AKIA', upper(substr(md5({_ID}), 1, 16))) AS key, concat('town', cast(conv_id AS varchar(20)), '-', cast(turn AS varchar(20))) AS city FROM conversations)"""


def _body(shape: str) -> Column:
    lit, said, told, call = F.lit, F.col("said"), F.col("told"), F.col("call")
    part = lambda kind, text: F.struct(lit(kind).alias("type"), text.alias("text"))
    v = F.to_variant_object
    return {
        "anthropic": lambda: F.struct(F.array(v(F.struct(lit("user").alias("role"), said.alias("content"))), v(F.struct(lit("user").alias("role"), F.array(F.struct(lit("tool_result").alias("type"), call.alias("tool_use_id"), told.alias("content"))).alias("content")))).alias("messages")),
        "openai": lambda: F.struct(F.array(v(F.struct(lit("user").alias("role"), F.array(part("text", said)).alias("content"))), v(F.struct(lit("tool").alias("role"), call.alias("tool_call_id"), told.alias("content")))).alias("messages")),
        "responses": lambda: F.struct(F.array(v(F.struct(lit("user").alias("role"), F.array(part("input_text", said)).alias("content"))), v(F.struct(lit("function_call_output").alias("type"), call.alias("call_id"), told.alias("output")))).alias("input")),
        "gemini": lambda: F.struct(F.array(F.struct(F.array(v(F.struct(said.alias("text"))), v(F.struct(F.struct(call.alias("id"), F.struct(F.array(told).alias("lines")).alias("response")).alias("functionResponse")))).alias("parts"))).alias("contents")),
    }[shape]()


def _protected(shape: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What a request's text and its tool's result are after it is made safe, and what was found; nulls where it may not go out."""
        rows = derived(spark, sf_dir, "conversations", TEXTS)
        safe = written(protect_requests(rows.select("id", F.to_json(_body(shape)).alias("body")), "id", "body", shape, "salt").drop("mocks"))
        texts = request_texts(safe, "id", "body", shape).groupBy(F.col("id").alias("of")).agg(F.max(F.when(F.col("kind") == "text", F.col("text"))).alias("said"), F.max(F.when(F.col("kind") == "tool_result", F.col("text"))).alias("told"))
        return safe.join(texts, F.col("id") == F.col("of"), "left").select("id", "said", "told", "n_secrets", "env_blocks", "changed", "leaked", "blocked")

    return query


def new_folder(spark: SparkSession) -> str:
    """A new folder within the shared one."""
    return f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"


PAIRS = """SELECT concat('c', cast(o_custkey % 20 AS varchar(20))) AS session, concat('m', cast(o_orderkey % 997 AS varchar(20))) AS mock, md5(cast(o_orderkey AS varchar(20))) AS real, concat('b', cast(o_orderkey % 4 AS varchar(20))) AS batch FROM orders"""


def session_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches in another order than their names', two of them twice, with a compaction between."""
    pairs = derived(spark, sf_dir, "orders", PAIRS)
    registry = SessionRegistry(spark, new_folder(spark))
    for name in ("b2", "b0", "b0", "", "b3", "b1", "b2"):
        if name:
            registry.add_pairs(name, pairs.where(F.col("batch") == name))
        else:
            registry.compact()
    return registry.pairs()


def bodies_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages' urls lead to which format, by the path alone."""
    from veilmark.sources.wire import ROUTES, format_of

    endings = F.array(*[F.lit(e) for e in (*ROUTES, "/v1/models")])
    path = F.concat(F.col("url"), F.get(endings, F.pmod(F.col("page_id"), F.lit(len(ROUTES) + 1)).cast("int")), F.when(F.col("page_id") % 2 == 0, "?key=/v1/messages").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", format_of(path).alias("format"))


def queries() -> dict:
    return {f"requests_protected_{shape}": _protected(shape) for shape in FORMATS} | {"session_registry": session_registry, "bodies_routed": bodies_routed}


def oracle_sql() -> dict[str, str]:
    env = lambda x: f"'VEILMARK_MOCK_ENV_' || upper({tag_sql(x, 6)})"
    protected = f"""WITH t AS ({TEXTS}), m AS (SELECT *, 'VEILMARK_MOCK_AWS_ACCESS_KEY_' || upper({tag_sql('key', 12)}) AS mock, {env('key')} AS env_key, {env('city')} AS env_city FROM t)
      SELECT id, CASE k WHEN 3 THEN NULL WHEN 0 THEN replace(replace(said, key, env_key), 'CITY=' || city, 'CITY=' || env_city) ELSE replace(said, key, mock) END AS said, CASE WHEN k = 3 THEN NULL ELSE replace(told, key, mock) END AS told,
        CAST(k IN (1, 3, 4) AS BIGINT) AS n_secrets, CAST(k = 0 AS BIGINT) AS env_blocks, k <> 2 AS changed, k = 3 AS leaked, k = 3 AS blocked FROM m"""
    return {f"requests_protected_{shape}": protected for shape in FORMATS} | {
        "session_registry": f"WITH t AS ({PAIRS}) SELECT session, mock, real FROM t QUALIFY row_number() OVER (PARTITION BY session, mock ORDER BY batch, real) = 1",
        "bodies_routed": "SELECT page_id, CASE WHEN contains(url, '?') THEN NULL ELSE CASE page_id % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'responses' WHEN 3 THEN 'gemini' WHEN 4 THEN 'gemini' END END AS format FROM pages",
    }

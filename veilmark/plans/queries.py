"""Registered queries of the library and the same in DuckDB's SQL.

Sentences with keys, addresses and settings are built from relational columns by expressions that both engines read alike,
because the text tables hold few secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.text import entropy, has_char_mix, mask_value, match_starts, window, has_any
from veilmark.operators.config import CONTEXT_WORDS, DEV_WORDS, PROD_WORDS, ScanConfig
from veilmark.operators.detect import candidates, judged, scan, spread, valid_card
from veilmark.operators.envfile import looks_like_env, mask_env
from veilmark.operators.infra import InfraConfig, mask_infra
from veilmark.operators.policy import decide, incident_report, incidents, retain_last
from veilmark.operators.shared import written
from veilmark.operators.transform import mock_for, redact, rehydrate, swap_table, swapped
from veilmark.plans import names, policies, projects, protect, requests, sse
from veilmark.plans.derived import derived, table, tag_sql
from veilmark.plans.examples import cases, cases_sql, judged_sql
from veilmark.sources.policyfile import load_policy
from veilmark.sources.rules import builtin_rules
from veilmark.sources.wire import FORMATS, REQUEST_HEADERS_DROPPED, kept_headers, request_texts, sse_events, written_back
from veilmark.streaming.rehydrate import cut_into_chunks, rehydrate_chunks

KEY_TEXTS = """SELECT o_orderkey AS id, 'access key AKIA' || upper(substr(md5(cast(o_orderkey AS varchar(20))), 1, 16)) || CASE o_orderkey % 4 WHEN 0 THEN ' in prod' WHEN 1 THEN ' in dev' WHEN 2 THEN ' of example' ELSE ' at noon' END AS text FROM orders"""
ENV_TEXTS = """SELECT c_custkey AS id, 'NAME=' || replace(c_name, '#', '-') || chr(10) || 'SEGMENT="' || c_mktsegment || '"' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'if (x) { return y; }' ELSE 'NATION=' || cast(c_nationkey AS varchar(20)) END AS text FROM customer"""
URL_TEXTS = """SELECT s_suppkey AS id, 'postgres://user' || cast(s_suppkey AS varchar(20)) || ':pw' || md5(cast(s_suppkey AS varchar(20))) || '@db' || cast(s_nationkey AS varchar(20)) || '.corp.net:5432/main' AS text FROM supplier"""
HOST_TEXTS = """SELECT s_suppkey AS id, 'ssh db' || cast(s_suppkey AS varchar(20)) || '.corp.internal via 10.1.2.' || cast(s_suppkey % 200 AS varchar(20)) AS text FROM supplier"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


CARD = r"(?<![A-Za-z0-9_])[2-6](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_])"


def findings_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule without any Python: places of matches from the gaps between them."""
    found, starts = match_starts(F.col("text"), CARD)
    rows = spread(documents(spark, sf_dir)).where(F.col("text").rlike(CARD)).select("doc_id", "text", F.explode(F.arrays_zip(found.alias("value"), starts.alias("start"))).alias("m"))
    rows = rows.select("doc_id", "text", F.col("m.value").alias("value"), F.col("m.start").alias("start")).withColumn("end", F.col("start") + F.length("value"))
    rows = rows.where(valid_card(F.col("value")) & ~has_any(window(F.col("text"), F.col("start"), F.col("end"), 12), ScanConfig().allowed()))
    return rows.select("doc_id", "start", "end", mask_value(F.col("value")).alias("masked"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("key", F.struct("doc_id", F.monotonically_increasing_id().alias("row")))  # ids may be null or repeat
    found = scan(rows, "key")
    f = F.explode("findings").alias("f")
    return found.select(F.col("id.doc_id").alias("doc_id"), f).select("doc_id", "f.rule_id", "f.type", "f.confidence", "f.environment", "f.start", "f.end", mask_value(F.col("f.value")).alias("masked"))


def scan_counts_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule set's card findings must be those of the one rule."""
    return scan_documents(spark, sf_dir).where("rule_id = 'pii.credit_card'").select("doc_id", "start", "end", "masked")


RULE_TEXTS = "SELECT n_nationkey * 10000 + c.id AS id, n_name || ': ' || c.text AS text FROM nation CROSS JOIN (VALUES {cases}) AS c(id, text)"


def rules_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule finds, before overlaps are resolved, in texts that it should and should not find."""
    shown = spark.createDataFrame(cases(), "case int, token string")
    rows = table(spark, sf_dir, "nation").join(F.broadcast(shown))  # a fixed list of some 1000 texts
    texts = rows.select((F.col("n_nationkey") * 10000 + F.col("case")).alias("id"), F.concat("n_name", F.lit(": "), "token").alias("text"))
    config = ScanConfig()
    found = judged(candidates(texts, "id", "text", config), config)
    return found.where("layer = 'known_pattern' and rule_id <> 'pii.credit_card'").select("id", "rule_id", "value", "start")


def decide_key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide(scan(derived(spark, sf_dir, "orders", KEY_TEXTS), "id", "text"))
    f = F.element_at("findings", 1)
    return found.select("id", F.size("findings").alias("n_findings"), f["rule_id"].alias("rule_id"), f["environment"].alias("environment"), f["start"].alias("start"), "action", "summary")


def redact_key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = derived(spark, sf_dir, "orders", KEY_TEXTS)
    found = scan(texts, "id", "text")
    return texts.join(found, "id", "left").select("id", F.when(F.col("findings").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("findings"))).alias("redacted"))


def incident_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_report(incidents(decide(scan(derived(spark, sf_dir, "orders", KEY_TEXTS), "id", "text")), "batch"))


def incidents_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("site_id"))
    return retain_last(rows, ["site_id"], 500).select("id", "site_id")


def swap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come back other than they were, values that are still there, and stand-ins that two values share: all 0."""
    texts = derived(spark, sf_dir, "orders", KEY_TEXTS)
    found = written(scan(texts, "id", "text"))
    pairs = swap_table(found, "salt")
    out = swapped(texts, "id", "text", found, pairs)
    broken = F.count_if(rehydrate(F.col("swapped"), F.col("mocks")) != F.col("text"))
    left = F.count_if(F.exists("mocks", lambda m: F.contains(F.col("swapped"), m["real"])))
    clashes = pairs.groupBy("mock").count().where("count > 1").agg(F.count(F.lit(1)).alias("clashes"))
    return out.agg(F.count(F.lit(1)).alias("n_texts"), broken.alias("broken"), left.alias("survivors")).join(F.broadcast(clashes))


def mock_database_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "supplier", URL_TEXTS)
    mock = mock_for(F.col("text"), F.lit("database_url"), F.lit(None).cast("string"), "salt", ScanConfig())
    return rows.select("id", mock.alias("mock"))


def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "orders", KEY_TEXTS).select("id", F.regexp_extract("text", "AKIA[A-Z0-9]{16}", 0).alias("token"))
    return rows.select("id", F.round(entropy(F.col("token")), 6).alias("bits"), has_char_mix(F.col("token")).alias("mixed"), mask_value(F.col("token")).alias("masked"))


def env_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "customer", ENV_TEXTS).select("id", looks_like_env(F.col("text")).alias("is_env"))


def env_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mask_env(derived(spark, sf_dir, "customer", ENV_TEXTS), "id", "text", "salt")
    return out.select("id", "is_env", "masked", (rehydrate(F.col("masked"), F.col("mocks")) == F.col("text")).alias("comes_back"))


POLICY = """{"version": 1, "patterns": [{"name": "Employee ID", "action": "block", "match": {"type": "prefix", "prefix": "EMP-", "format": {"kind": "digits", "length": 6}}, "examples": {"match": ["EMP-000123"], "noMatch": ["EMP-12"]}},
 {"name": "Mail", "match": {"type": "known", "format": "email"}}, {"name": "Desk", "match": {"type": "context", "keywords": ["desk"], "value": {"kind": "hex", "min": 4, "max": 8}}}],
 "internalDomains": ["acme.io"], "blocklist": ["BUILDING", "house hold"], "policy": {"pii": {"ssn": false}}}"""
STAFF_TEXTS = """SELECT c_custkey AS id, 'badge EMP-' || lpad(cast(c_custkey AS varchar(20)), CASE WHEN c_custkey % 5 = 0 THEN 5 ELSE 6 END, '0') || ' of ' || lower(c_mktsegment) || ', 219-09-9999, mail c' || cast(c_custkey AS varchar(20)) || '@post.acme.io at desk: ' || substr(md5(cast(c_custkey AS varchar(20))), 1, 6) || ' on www.acme.io' AS text FROM customer"""


def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an organisation's own rules find; one of the built-in rules is switched off."""
    config = load_policy(POLICY).scan_config()
    found = decide(scan(derived(spark, sf_dir, "customer", STAFF_TEXTS), "id", "text", config), config)
    return found.select("id", "action", F.explode("findings").alias("f")).select("id", "action", "f.rule_id", "f.start", "f.value", "f.mask_hint")


def infra_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "supplier", HOST_TEXTS)
    masked = mask_infra(F.col("text"), InfraConfig("salt"))
    shape = F.regexp_replace(F.regexp_replace(masked, "host-[0-9a-z]{6}", "host-TAG"), r"10\.[0-9]+\.[0-9]+\.[0-9]+", "ADDRESS")
    return rows.select("id", shape.alias("shape"))


def _bodies(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    text = F.coalesce("text", F.lit(""))
    part = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    body = {
        "anthropic": F.struct(F.lit("be brief").alias("system"), F.array(F.struct("role", part.alias("content"))).alias("messages")),
        "openai": F.struct(F.array(F.struct("role", text.alias("content"))).alias("messages")),
        "responses": F.struct(F.lit("be brief").alias("instructions"), text.alias("input")),
        "gemini": F.struct(F.array(F.struct("role", F.array(F.struct(text.alias("text"))).alias("parts"))).alias("contents")),
    }[shape]
    return rows.select("id", F.to_json(body).alias("body"))


def _wire(shape: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return request_texts(_bodies(spark, sf_dir, shape), "id", "body", shape).select("id", "kind", "text")

    return query


def _tool_bodies(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """Bodies with bracket texts, lists of parts and tool results; every third text stays as it is."""
    rows = spread(table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("t")))
    t, said = F.col("t"), F.concat(F.lit("[INST] "), "t")
    lit = F.lit
    part = lambda kind, text: F.struct(lit(kind).alias("type"), text.alias("text"))
    body = {
        "anthropic": F.struct(
            F.array(part("text", lit("rules"))).alias("system"),
            F.array(
                F.to_variant_object(F.struct(lit("user").alias("role"), said.alias("content"))),
                F.to_variant_object(F.struct(lit("user").alias("role"), F.array(F.struct(lit("tool_result").alias("type"), lit("call-1").alias("tool_use_id"), F.array(part("text", t)).alias("content"))).alias("content"))),
            ).alias("messages"),
        ),
        "openai": F.struct(
            F.array(
                F.to_variant_object(F.struct(lit("system").alias("role"), lit("rules").alias("content"))),
                F.to_variant_object(F.struct(lit("user").alias("role"), F.array(part("text", said)).alias("content"))),
                F.to_variant_object(F.struct(lit("tool").alias("role"), lit("call-1").alias("tool_call_id"), t.alias("content"))),
            ).alias("messages")
        ),
        "responses": F.struct(
            lit("rules").alias("instructions"),
            F.array(
                F.to_variant_object(F.struct(lit("message").alias("type"), F.array(part("input_text", said)).alias("content"))),
                F.to_variant_object(F.struct(lit("function_call_output").alias("type"), lit("call-1").alias("call_id"), t.alias("output"))),
            ).alias("input"),
        ),
        "gemini": F.struct(
            F.struct(F.array(F.struct(lit("rules").alias("text"))).alias("parts")).alias("systemInstruction"),
            F.array(F.struct(F.array(F.to_variant_object(F.struct(said.alias("text"))), F.to_variant_object(F.struct(F.struct(lit("call-1").alias("id"), F.struct(F.array(t).alias("lines")).alias("response")).alias("functionResponse")))).alias("parts"))).alias("contents"),
        ),
    }[shape]
    return rows.select("id", F.to_json(body).alias("body"))


NOTE = "repeat names as they are"


def _written(shape: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts with an even number of characters are changed and written back; what the new bodies then hold."""
        bodies = _tool_bodies(spark, sf_dir, shape)
        texts = request_texts(bodies, "id", "body", shape)
        changed = texts.where(F.length("text") % 2 == 0).withColumn("text", F.concat(F.lit("<"), "text", F.lit(">")))
        out = written_back(bodies, "id", "body", shape, changed, NOTE)
        calls = F.contains("body", F.lit("call-1")).alias("has_call")
        return request_texts(out, "id", "body", shape).join(out.select("id", calls), "id").select("id", "kind", "text", "has_call")

    return query


def sse_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("event: a\ndata: "), "r_name", F.lit("\r\n\r\ndata: x\ndata: y\n\n")).alias("body"))
    return sse_events(rows, "r_regionkey", "body").select(F.col("id").alias("r_regionkey"), "seq", "event", "data")


def headers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("Host"), F.lit("h"), F.lit("X-Nation"), "n_name", F.lit("Accept-Encoding"), F.lit("gzip")).alias("headers"))
    return rows.select("n_nationkey", F.explode(kept_headers(F.col("headers"), REQUEST_HEADERS_DROPPED)).alias("name", "value"))


def stream_rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins cut anywhere come back whole: the chunks' outputs, joined, are the original texts."""
    texts = derived(spark, sf_dir, "orders", KEY_TEXTS)
    found = written(scan(texts, "id", "text"))
    out = swapped(texts, "id", "text", found, swap_table(found, "salt")).withColumn("size", F.pmod("id", F.lit(7)) + 1)
    chunks = cut_into_chunks(out, "id", "swapped", "size")
    mapping = out.select(F.col("id").cast("string").alias("stream_id"), F.explode("mocks").alias("m")).select("stream_id", "m.mock", "m.real")
    back = rehydrate_chunks(chunks, mapping).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "out"))).alias("parts"))
    return back.select(F.col("stream_id").cast("bigint").alias("id"), F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("text"))


def queries() -> dict:
    own = [findings_credit_card, rules_judged, scan_documents, scan_counts_cards, decide_key_texts, redact_key_texts, incident_counts, incidents_retained, swap_round_trip, mock_database_urls, token_entropy, env_sniff, env_masked, policy_findings, infra_masked, sse_framed, headers_kept, stream_rehydrated]
    wire = {f"wire_{n}": _wire(n) for n in FORMATS} | {f"wire_{n}_written": _written(n) for n in FORMATS}
    return {f.__name__: f for f in own} | wire | names.queries() | protect.queries() | sse.queries() | requests.queries() | projects.queries() | policies.queries()


_STARS = "left({0}, 4) || repeat('*', least(length({0}) - 4, 24))"
_CARD_SQL = rf"""
WITH gaps AS (SELECT doc_id, text, regexp_split_to_array(text, '\b[2-6](?:[ -]?\d){{12,18}}\b') AS g, regexp_extract_all(text, '\b[2-6](?:[ -]?\d){{12,18}}\b') AS m FROM documents WHERE regexp_matches(text, '\b[2-6](?:[ -]?\d){{12,18}}\b')),
each AS (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM gaps),
spans AS (SELECT doc_id, text, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s FROM each),
digits AS (SELECT *, regexp_replace(value, '\D', '', 'g') AS d, lower(substr(text, greatest(s - 12, 0) + 1, s + length(value) + 12 - greatest(s - 12, 0))) AS w FROM spans),
summed AS (SELECT *, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) AS luhn FROM digits)
SELECT doc_id, s AS start, CAST(s + length(value) AS INTEGER) AS "end", {_STARS.format('value')} AS masked FROM summed
WHERE luhn % 10 = 0 AND ((d[1] = '4' AND length(d) IN (13, 16, 19)) OR (left(d, 2) IN ('34', '37') AND length(d) = 15) OR (CAST(left(d, 2) AS INT) BETWEEN 51 AND 55 AND length(d) = 16)
  OR (CAST(left(d, 4) AS INT) BETWEEN 2221 AND 2720 AND length(d) = 16) OR ((left(d, 4) = '6011' OR left(d, 2) = '65' OR CAST(left(d, 3) AS INT) BETWEEN 644 AND 649) AND length(d) BETWEEN 16 AND 19))
  AND NOT regexp_matches(w, 'localhost|127\.0\.0\.1|0\.0\.0\.0|example|your-|xxxx|<your|placeholder|changeme|change-me|redacted|dummy|notreal|foobar')
"""
_KEYS = f"WITH t AS ({KEY_TEXTS})"
_FOUND = "id % 4 <> 2"
_ENV = f"WITH t AS ({ENV_TEXTS})"


def _written_sql(listed: bool) -> str:
    """`listed`: the note is a further part of the system text; else it is joined to it.  "rules" has 5 characters and stays."""
    changed = lambda x: f"CASE WHEN length({x}) % 2 = 0 THEN '<' || {x} || '>' ELSE {x} END"
    rules = f"SELECT id, 'text' AS kind, 'rules' AS text, true AS has_call FROM t UNION ALL SELECT id, 'text', '{NOTE}', true FROM t WHERE noted" if listed else rf"SELECT id, 'text' AS kind, CASE WHEN noted THEN 'rules' || chr(10) || chr(10) || '{NOTE}' ELSE 'rules' END AS text, true AS has_call FROM t"
    return f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, coalesce(text, '') AS t, '[INST] ' || coalesce(text, '') AS said FROM conversations),
      t AS (SELECT *, length(t) % 2 = 0 OR length(said) % 2 = 0 AS noted FROM c)
      {rules} UNION ALL SELECT id, 'text', {changed('said')}, true FROM t UNION ALL SELECT id, 'tool_result', {changed('t')}, true FROM t"""


def _scan_sql() -> str:
    """All findings of documents; cards are the only secrets that its texts hold, which the number of rows bears out."""
    card = next(r for r in builtin_rules() if r.id == "pii.credit_card")
    one_of = lambda words: " OR ".join(f"contains(near, '{w}')" for w in words)
    raised = {"low": "medium", "medium": "high", "high": "high"}[card.confidence]
    return f"""WITH c AS ({_CARD_SQL}), n AS (SELECT c.*, lower(substr(d.text, greatest(c.start - 64, 0) + 1, c."end" + 64 - greatest(c.start - 64, 0))) AS near FROM c JOIN documents d USING (doc_id)),
      e AS (SELECT *, {one_of(PROD_WORDS)} AS prod, {one_of(DEV_WORDS)} AS dev FROM n)
      SELECT doc_id, '{card.id}' AS rule_id, '{card.type}' AS type, CASE WHEN {one_of(CONTEXT_WORDS)} THEN '{raised}' ELSE '{card.confidence}' END AS confidence,
        CASE WHEN prod AND NOT dev THEN 'prod' WHEN dev AND NOT prod THEN 'dev' ELSE 'unknown' END AS environment, start, "end", masked FROM e"""


def oracle_sql() -> dict[str, str]:
    wire = "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'text' AS kind, coalesce(text, '') AS text FROM conversations"
    brief = wire + " UNION ALL SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'text' AS kind, 'be brief' AS text FROM conversations"
    listed, joined = _written_sql(True), _written_sql(False)
    env = lambda x: f"'VEILMARK_MOCK_ENV_' || upper({tag_sql(x, 6)})"
    return {
        "findings_credit_card": _CARD_SQL,
        "scan_counts_cards": _CARD_SQL,
        "scan_documents": _scan_sql(),
        "rules_judged": judged_sql(RULE_TEXTS.format(cases=cases_sql())),
        "decide_key_texts": f"""{_KEYS} SELECT id, CAST(1 AS INTEGER) AS n_findings, 'aws.access_key_id' AS rule_id, CASE id % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' ELSE 'unknown' END AS environment, CAST(11 AS INTEGER) AS start,
          CASE WHEN id % 4 = 1 THEN 'warn' ELSE 'block' END AS action, CASE WHEN id % 4 = 1 THEN 'Warning: possible AWS access key detected.' ELSE 'Blocked: AWS access key detected.' END AS summary FROM t WHERE {_FOUND}""",
        "redact_key_texts": f"{_KEYS} SELECT id, regexp_replace(text, 'AKIA[A-Z0-9]{{16}}', '[REDACTED_AWS_ACCESS_KEY]') AS redacted FROM t WHERE {_FOUND} UNION ALL SELECT id, text FROM t WHERE NOT ({_FOUND})",
        "incident_counts": f"{_KEYS} SELECT 'aws_access_key' AS secret_type, count(*) AS n, count(*) FILTER (WHERE id % 4 <> 1) AS blocked FROM t WHERE {_FOUND}",
        "incidents_retained": "SELECT event_id AS id, event_type AS site_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500",
        "swap_round_trip": "SELECT count(*) AS n_texts, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS survivors, CAST(0 AS BIGINT) AS clashes FROM orders",
        "mock_database_urls": f"WITH t AS ({URL_TEXTS}) SELECT id, 'postgres://user:mock_' || {tag_sql('text', 6)} || '@mock-host.example:5432/mock_db' AS mock FROM t",
        "token_entropy": f"""WITH t AS (SELECT id, regexp_extract(text, 'AKIA[A-Z0-9]{{16}}') AS token FROM ({KEY_TEXTS}))
          SELECT id, round(list_aggregate(string_split(token, ''), 'entropy'), 6) AS bits, regexp_matches(token, '[0-9]') AS mixed, {_STARS.format('token')} AS masked FROM t""",
        "env_sniff": f"{_ENV} SELECT id, id % 3 <> 0 AS is_env FROM t",
        "env_masked": f"""{_ENV} SELECT id, id % 3 <> 0 AS is_env, CASE WHEN id % 3 = 0 THEN text ELSE 'NAME=' || {env("regexp_extract(text, 'NAME=([^ ]*)', 1)".replace('[^ ]*', '.*'))} || chr(10) || 'SEGMENT="' || {env("regexp_extract(text, 'SEGMENT=.([A-Z]*)', 1)")} || '"' || chr(10) || 'NATION=' || {env("regexp_extract(text, 'NATION=([0-9]*)', 1)")} END AS masked, true AS comes_back FROM t""",
        "policy_findings": f"""WITH t AS (SELECT *, CASE WHEN id % 5 <> 0 THEN 'block' ELSE 'warn' END AS action FROM ({STAFF_TEXTS})),
          v AS (SELECT id, text, action, 'policy.employee_id' AS rule_id, 'Employee ID' AS mask_hint, regexp_extract(text, 'EMP-[0-9]{{6}}') AS value FROM t WHERE id % 5 <> 0
            UNION ALL SELECT id, text, action, 'policy.mail', 'Mail', regexp_extract(text, 'c[0-9]+@post[.]acme[.]io') FROM t
            UNION ALL SELECT id, text, action, 'policy.blocklist', 'blocklisted term', 'building' FROM t WHERE contains(text, 'of building,'))
          SELECT id, action, rule_id, CAST(position(value IN text) - 1 AS INTEGER) AS start, value, mask_hint FROM v
          UNION ALL SELECT id, action, 'policy.desk', CAST(position('desk: ' IN text) + 7 AS INTEGER), substr(md5(cast(id AS varchar)), 3, 4), 'Desk' FROM t
          UNION ALL SELECT id, action, 'policy.internal_host', CAST(length(text) - 7 AS INTEGER), 'acme.io', 'internal host' FROM t""",
        "infra_masked": f"WITH t AS ({HOST_TEXTS}) SELECT id, 'ssh host-TAG.internal via ADDRESS' AS shape FROM t",
        "sse_framed": """SELECT r_regionkey, CAST(0 AS INTEGER) AS seq, 'a' AS event, r_name AS data FROM region UNION ALL SELECT r_regionkey, CAST(1 AS INTEGER), NULL, 'x' || chr(10) || 'y' FROM region""",
        "headers_kept": "SELECT n_nationkey, 'X-Nation' AS name, n_name AS value FROM nation",
        "stream_rehydrated": f"{_KEYS} SELECT id, text FROM t",
        "wire_anthropic_written": listed,
        "wire_openai_written": joined,
        "wire_responses_written": joined,
        "wire_gemini_written": listed,
        "wire_openai": wire,
        "wire_gemini": wire,
        "wire_anthropic": brief,
        "wire_responses": brief,
    } | names.oracle_sql() | protect.oracle_sql() | sse.oracle_sql() | requests.oracle_sql() | projects.oracle_sql() | policies.oracle_sql()

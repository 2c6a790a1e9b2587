"""Queries of lists and raw patterns of a policy, of texts that are safe already, and of the one rule that needs the word okta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.config import ScanConfig
from veilmark.operators.detect import candidates, judged, scan
from veilmark.operators.policy import already_safe, decide, decide_all
from veilmark.plans.derived import derived
from veilmark.sources.policyfile import load_policy

POLICY = """{"version": 1, "patterns": [{"name": "Segment", "match": {"type": "list", "terms": ["BUILDING", "house", "Machinery"], "wholeWord": true, "caseInsensitive": true}, "examples": {"match": ["machinery"], "noMatch": ["buildings"]}},
 {"name": "Ticket", "action": "block", "match": {"type": "regex", "advanced": true, "source": "TK-[0-9]{3,6}x", "flags": "i"}, "examples": {"match": ["tk-1234x"], "noMatch": ["TK-12x"]}}]}"""
TICKETS = """SELECT c_custkey AS id, concat('for ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE ' ' END, ' see tk-', cast(c_custkey AS varchar(20)), 'X today') AS text FROM customer"""
OKTA = """SELECT o_orderkey AS id, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'login ' ELSE 'Okta login ' END, token, ' end') AS text, token FROM (SELECT o_orderkey, concat('00', substr(md5(cast(o_orderkey AS varchar(20))), 1, 20), upper(substr(md5(concat('x', cast(o_orderkey AS varchar(20)))), 1, 20))) AS token FROM orders)"""
_KEY = "concat('AKIA', upper(substr(md5(concat({0}, cast(o_orderkey AS varchar(20)))), 1, 16)))"
SAFE = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'no key' ELSE concat('use ', {_KEY.format("'a'")}, CASE WHEN o_orderkey % 5 = 0 THEN concat(' and ', {_KEY.format("'b'")}) ELSE '' END) END AS text, CASE WHEN o_orderkey % 2 = 0 THEN {_KEY.format("'a'")} END AS known FROM orders"""


def policy_lists_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = load_policy(POLICY).scan_config()
    found = decide(scan(derived(spark, sf_dir, "customer", TICKETS), "id", "text", config), config)
    return found.select("id", "action", F.explode("findings").alias("f")).select("id", "action", "f.rule_id", "f.start", "f.value")


def okta_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ScanConfig()
    found = judged(candidates(derived(spark, sf_dir, "orders", OKTA), "id", "text", config), config)
    return found.where("rule_id = 'okta.access_token'").select("id", "value", "start", "confidence")


def texts_already_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts all of whose keys are known as stand-ins of their session."""
    rows = derived(spark, sf_dir, "orders", SAFE)
    found = rows.join(scan(rows, "id", "text"), "id", "left")
    return found.select("id", already_safe(F.col("findings"), F.array("known")).alias("safe"))


TEXTS = f"""SELECT o_orderkey AS id, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'no key' ELSE {_KEY.format("'c'")} END, CASE o_orderkey % 4 WHEN 0 THEN ' in dev' ELSE ' at noon' END) AS text FROM orders"""


def decisions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided about every text, those that are allowed included."""
    rows = derived(spark, sf_dir, "orders", TEXTS)
    return decide_all(rows, scan(rows, "id", "text")).select("id", F.size("findings").alias("n_findings"), "action", "summary")


def queries() -> dict:
    return {f.__name__: f for f in (decisions_all, policy_lists_found, okta_tokens, texts_already_safe)}


def oracle_sql() -> dict[str, str]:
    return {
        "policy_lists_found": f"""WITH t AS ({TICKETS}), k AS (SELECT *, regexp_extract(text, 'tk-[0-9]{{3,6}}X') AS ticket FROM t), a AS (SELECT *, CASE WHEN ticket <> '' THEN 'block' ELSE 'warn' END AS action FROM k)
          SELECT id, action, 'policy.ticket' AS rule_id, CAST(position(ticket IN text) - 1 AS INTEGER) AS start, ticket AS value FROM a WHERE ticket <> ''
          UNION ALL SELECT id, action, 'policy.segment', CAST(4 AS INTEGER), regexp_extract(text, '^for ([A-Z]+)', 1) FROM a WHERE regexp_matches(text, '^for (BUILDING|MACHINERY) ')""",
        "decisions_all": f"""WITH t AS ({TEXTS}) SELECT id, CAST(id % 3 <> 0 AS INTEGER) AS n_findings, CASE WHEN id % 3 = 0 THEN 'allow' WHEN id % 4 = 0 THEN 'warn' ELSE 'block' END AS action,
          CASE WHEN id % 3 = 0 THEN 'No secrets detected.' WHEN id % 4 = 0 THEN 'Warning: possible AWS access key detected.' ELSE 'Blocked: AWS access key detected.' END AS summary FROM t""",
        "okta_tokens": f"WITH t AS ({OKTA}) SELECT id, token AS value, CAST(11 AS INTEGER) AS start, 'high' AS confidence FROM t WHERE id % 3 <> 0 AND list_aggregate(string_split(token, ''), 'entropy') >= 4.0",
        "texts_already_safe": f"WITH t AS ({SAFE}) SELECT id, id % 7 = 0 OR (id % 2 = 0 AND id % 5 <> 0) AS safe FROM t",
    }

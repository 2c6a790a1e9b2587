"""Queries of name and literal stand-ins over names made from customers, and the same rules in SQL, hashes included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.config import ScanConfig
from veilmark.operators.names import COLUMN_SUFFIXES, ENTITY_NOUNS, GENERIC_COLUMNS, STOP_WORDS, TABLE_PREFIXES, NameConfig, name_masks, scrub_literals
from veilmark.operators.transform import rehydrate
from veilmark.plans.derived import derived, tag_sql

_WORD = "lower(c_mktsegment) || 'x' || substr(md5(cast(c_custkey % 50 AS varchar(20))), 1, 2)"
_OTHER = "'ghost' || substr(md5(cast(c_custkey AS varchar(20))), 5, 2)"
_NAMES = {
    "table": [f"CASE c_custkey % 4 WHEN 0 THEN 'mart_' || {_WORD} || '_orders' WHEN 1 THEN 'dim_' || {_WORD} WHEN 2 THEN {_WORD} || 'Postings' ELSE 'X' || {_WORD} END", "'users'"],
    "schema": [f"{_OTHER} || '_dwh'"],
    "column": [f"{_WORD} || '_probability'", "'created_at'", f"'Median' || upper({_OTHER})", "'order_total'", "'secret_' || substr(md5(cast(c_custkey AS varchar(20))), 9, 4) || '_flag'"],
    "alias": [f"'top_' || upper({_WORD})", "'plain_alias'", f"'n_' || {_OTHER} || '_by_' || {_WORD}", "'secret_share'", "'overMedian'"],
}
NAMES = " UNION ALL ".join(f"SELECT c_custkey AS scope, '{kind}' AS kind, {name} AS name FROM customer" for kind, names in _NAMES.items() for name in names)
LITERALS = """SELECT CASE c_custkey % 4 WHEN 0 THEN 'Sold to ' || c_mktsegment WHEN 1 THEN 'EMP-' || lpad(cast(c_custkey AS varchar(20)), 6, '0') WHEN 2 THEN 'use AKIA' || upper(substr(md5(cast(c_custkey AS varchar(20))), 1, 16)) || ' now' ELSE c_name END AS value FROM customer"""
CONFIG = NameConfig(salt="salt", column_patterns=("^secret_",), blocked=("Building",), value_patterns=("^EMP-[0-9]{6}$",))


def names_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_masks(derived(spark, sf_dir, "customer", NAMES), CONFIG)


def literals_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scrub_literals(derived(spark, sf_dir, "customer", LITERALS), CONFIG)
    back = rehydrate(F.col("mask"), F.col("mocks")) == F.col("value")
    return out.select("value", "mask", back.alias("comes_back"))


def _hash_sql(x: str) -> str:
    """The first six base-36 digits of 64 bits of SHA-256."""
    n = f"CAST(CAST('0x' || substr(sha256('{CONFIG.salt}:' || {x}), 1, 16) AS UBIGINT) AS HUGEINT)"
    steps = " ".join(f"WHEN {n} >= {36**d} THEN {n} // {36**(d - 5)}" for d in range(12, 5, -1))
    return f"lower(to_base(CAST(CASE {steps} ELSE {n} END AS BIGINT), 36, 6))"


def _words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_\s]+'), lambda w: w <> '')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def oracle_sql() -> dict[str, str]:
    general = [*TABLE_PREFIXES, *ENTITY_NOUNS, *COLUMN_SUFFIXES, *STOP_WORDS, *(w for c in GENERIC_COLUMNS for w in c.split("_"))]
    concepts = f"SELECT scope, w FROM (SELECT scope, unnest(words) AS w FROM {{0}}) WHERE length(w) >= 4 AND w NOT IN {_in(general)}"
    names = f"""WITH t AS ({NAMES}), r AS (SELECT DISTINCT * FROM t WHERE scope IS NOT NULL AND name IS NOT NULL),
      f AS (SELECT *, {_words_sql('name')} AS words, kind = 'column' AND starts_with(name, 'secret_') AS secret, {_hash_sql('name')} AS h FROM r),
      found AS (SELECT * FROM f WHERE kind IN ('table', 'schema') OR secret), c AS ({concepts.format('found')}),
      cols AS (SELECT * FROM f WHERE kind = 'column' AND NOT secret AND name NOT IN {_in(GENERIC_COLUMNS)} AND EXISTS (SELECT 1 FROM c WHERE c.scope = f.scope AND contains(lower(f.name), c.w))),
      e AS (SELECT * FROM c UNION {concepts.format('cols')}),
      a AS (SELECT f.scope, f.name, list(e.w || '=c' || {_hash_sql('e.w')} ORDER BY length(e.w) DESC, e.w) AS swaps FROM f JOIN e ON f.scope = e.scope AND contains(lower(f.name), e.w) WHERE f.kind = 'alias' GROUP BY f.scope, f.name),
      m AS (SELECT scope, kind, name, CASE kind WHEN 'schema' THEN 'schema_' || h
          WHEN 'column' THEN CASE WHEN words[-1] IN {_in(COLUMN_SUFFIXES)} THEN h || '_' || words[-1] ELSE 'col_' || h END
          ELSE CASE WHEN words[1] IN {_in(TABLE_PREFIXES)} THEN words[1] || '_' ELSE '' END || CASE WHEN words[-1] IN {_in(ENTITY_NOUNS)} THEN words[-1] || '_' ELSE '' END
            || CASE WHEN words[1] IN {_in(TABLE_PREFIXES)} OR words[-1] IN {_in(ENTITY_NOUNS)} THEN '' ELSE 'tbl_' END || h END AS mask FROM (SELECT * FROM found UNION ALL SELECT * FROM cols)
        UNION ALL SELECT scope, 'alias', name, list_reduce(list_prepend(name, swaps), lambda s, x: regexp_replace(s, split_part(x, '=', 1), split_part(x, '=', 2), 'gi')) FROM a)
      SELECT r.scope, r.kind, r.name, m.mask FROM r LEFT JOIN m USING (scope, kind, name)"""
    literals = f"""WITH v AS (SELECT DISTINCT value FROM ({LITERALS}) WHERE value <> '')
      SELECT value, CASE WHEN contains(lower(value), 'building') THEN 'veilmark_blocked_' || {_hash_sql('value')} WHEN starts_with(value, 'EMP-') THEN 'veilmark_redacted_' || {_hash_sql('value')}
        ELSE 'use {ScanConfig().marker}AWS_ACCESS_KEY_' || upper({tag_sql("regexp_extract(value, 'AKIA[A-Z0-9]+')", 12)}) || ' now' END AS mask, true AS comes_back FROM v WHERE contains(lower(value), 'building') OR regexp_matches(value, '^EMP-[0-9]{{6}}$') OR contains(value, 'AKIA')"""
    return {"names_masked": names, "literals_scrubbed": literals}


def queries() -> dict:
    return {f.__name__: f for f in (names_masked, literals_scrubbed)}

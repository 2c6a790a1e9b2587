"""Queries of SQL texts, manifests, imports and the incident sink, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.incidents import IncidentSink
from veilmark.operators.names import name_masks
from veilmark.operators.sqltext import mask_sql
from veilmark.plans import names
from veilmark.plans.derived import derived, table
from veilmark.plans.requests import new_folder
from veilmark.sources.manifests import ImportConfig, imports_masked, manifests

_TABLE, _SCHEMA, _COLUMN, _SECRET, _ALIAS = (names._NAMES[kind][n] for kind, n in (("table", 0), ("schema", 0), ("column", 0), ("column", 4), ("alias", 0)))
#: Comments within comments, doubled quotes, a dollar quote, names in strings, a name from WITH, and quoted names.
_STATEMENT = """concat('WITH feed AS (SELECT p.', {column}, ' AS "gp", p.', {secret}, ' FROM ', {schema}, '.', {table}, ' p /* ', {raw_table}, ' /* don''t */ ', {raw_column}, ' */ WHERE p.seg = ''', {seg}, ''' AND p.note = ''it''''s ', {raw_table}, ''')', chr(10),
  'SELECT "gp" AS ', {alias}, ', $q$', {seg}, '$q$, users.id -- ', {raw_column}, chr(10), 'FROM feed JOIN users ON users.id = feed.', {column}, ' ORDER BY ', {alias}, ';')"""
_FIELDS = {"column": _COLUMN, "secret": _SECRET, "schema": _SCHEMA, "table": _TABLE, "alias": _ALIAS, "raw_table": _TABLE, "raw_column": _COLUMN, "seg": "c_mktsegment"}
STATEMENTS = f"SELECT c_custkey AS id, {_STATEMENT.format(**_FIELDS)} AS sql FROM customer"


def sql_texts_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = derived(spark, sf_dir, "customer", STATEMENTS)
    masks = name_masks(derived(spark, sf_dir, "customer", names.NAMES), names.CONFIG)
    literals = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")).distinct().withColumn("mask", F.concat(F.lit("L'"), F.lower("value")))
    return mask_sql(statements, "id", "sql", masks, literals, "postgres")


FILES = """SELECT concat('/repo/n', cast(s_nationkey AS varchar(20)), CASE WHEN s_suppkey % 2 = 0 THEN '/sub' ELSE '' END, '/', CASE s_nationkey % 5 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'pyproject.toml' WHEN 3 THEN 'Cargo.toml' ELSE 'Acme.csproj' END) AS path,
  min(CASE s_nationkey % 5 WHEN 0 THEN concat('// x', chr(10), 'module acme.io/n', cast(s_nationkey AS varchar(20)), chr(10)) WHEN 1 THEN concat('<project><groupId> io.acme.n', cast(s_nationkey AS varchar(20)), ' </groupId></project>')
    WHEN 2 THEN concat('[project]', chr(10), 'name = "acme-n', cast(s_nationkey AS varchar(20)), '"') WHEN 3 THEN 'no name here' ELSE concat('<RootNamespace>Acme', cast(s_nationkey AS varchar(20)), '.Web</RootNamespace>') END) AS content
  FROM supplier GROUP BY 1"""
IMPORTS = """SELECT s_suppkey AS id, concat('/repo/n', cast(s_nationkey AS varchar(20)), CASE s_suppkey % 3 WHEN 0 THEN '/sub/deep/' WHEN 1 THEN '/src/' ELSE '/' END, 'file.x') AS path,
  CASE s_nationkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'java' WHEN 2 THEN 'python' WHEN 3 THEN 'rust' ELSE 'csharp' END AS language,
  CASE s_suppkey % 7 WHEN 0 THEN './billing/entry.js' WHEN 1 THEN 'node:fs' WHEN 2 THEN 'lodash' WHEN 3 THEN '@acme/core' ELSE CASE s_nationkey % 5 WHEN 0 THEN concat('acme.io/n', cast(s_nationkey AS varchar(20)), '/pay') WHEN 1 THEN concat('io.acme.n', cast(s_nationkey AS varchar(20)), '.pay')
    WHEN 2 THEN concat('acme_n', cast(s_nationkey AS varchar(20))) WHEN 3 THEN 'crate_x' ELSE concat('Acme', cast(s_nationkey AS varchar(20)), '.Pay') END END AS module, s_name AS name FROM supplier"""
IMPORT_CONFIG = ImportConfig("salt", scopes=("@acme/",))


def manifests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests(derived(spark, sf_dir, "supplier", FILES))


def imports_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports_masked(derived(spark, sf_dir, "supplier", IMPORTS), manifests(derived(spark, sf_dir, "supplier", FILES)), IMPORT_CONFIG)


def incidents_sunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents of their type's site, in four batches of which two come twice."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("site_id"))
    sink = IncidentSink(spark, new_folder(spark), 50)
    for batch in (0, 1, 1, 2, 0, 3):
        sink.add(rows.where(F.pmod("id", F.lit(4)) == batch), batch)
    return sink.incidents().select("id", "site_id")


def queries() -> dict:
    return {f.__name__: f for f in (sql_texts_masked, manifests_read, imports_by_project, incidents_sunk)}


def oracle_sql() -> dict[str, str]:
    joined = " ".join(f"LEFT JOIN (SELECT scope, name, mask FROM names WHERE kind = '{k}') {n} ON {n}.scope = c_custkey AND {n}.name = {expr}" for n, k, expr in (("mc", "column", _COLUMN), ("ms", "column", _SECRET), ("mh", "schema", _SCHEMA), ("mt", "table", _TABLE), ("ma", "alias", _ALIAS), ("mu", "table", "'users'")))
    masked = f"""'WITH feed AS (SELECT p.' || coalesce(mc.mask, {_COLUMN}) || ' AS "gp", p.' || coalesce(ms.mask, {_SECRET}) || ' FROM ' || coalesce(mh.mask, {_SCHEMA}) || '.' || coalesce(mt.mask, {_TABLE}) || ' p   WHERE p.seg = ''L''''' || lower(c_mktsegment) || ''' AND p.note = ''it''''s ' || {_TABLE} || ''')' || chr(10)
      || 'SELECT "gp" AS ' || coalesce(ma.mask, {_ALIAS}) || ', $q$L''' || lower(c_mktsegment) || '$q$, ' || coalesce(mu.mask, 'users') || '.id ' || chr(10) || 'FROM feed JOIN ' || coalesce(mu.mask, 'users') || ' ON ' || coalesce(mu.mask, 'users') || '.id = feed.' || coalesce(mc.mask, {_COLUMN}) || ' ORDER BY ' || coalesce(ma.mask, {_ALIAS}) || ';'"""
    h = lambda x: names._hash_sql(x)
    projects = f"""f AS ({FILES}), p AS (SELECT regexp_replace(path, '/[^/]*$', '') AS project, unnest(CASE WHEN path LIKE '%pom.xml' THEN ['java', 'kotlin'] WHEN path LIKE '%go.mod' THEN ['go'] WHEN path LIKE '%.csproj' THEN ['csharp'] WHEN path LIKE '%Cargo.toml' THEN ['rust'] ELSE ['python'] END) AS language,
      CASE WHEN path LIKE '%pom.xml' THEN regexp_extract(content, '<groupId> (.*) </groupId>', 1) || '.' WHEN path LIKE '%go.mod' THEN trim(regexp_extract(content, 'module ([^ \\n]*)', 1)) WHEN path LIKE '%.csproj' THEN regexp_extract(content, '>([^.]*)', 1) || '.'
        WHEN path LIKE '%Cargo.toml' THEN NULL ELSE replace(regexp_extract(content, 'name = "(.*)"', 1), '-', '_') END AS prefix, CASE WHEN path LIKE '%Cargo.toml' THEN 'no name found in Cargo.toml' END AS problem FROM f)"""
    return {
        "sql_texts_masked": f"WITH names AS ({names.oracle_sql()['names_masked']}) SELECT c_custkey AS id, {masked} AS sql FROM customer {joined}",
        "manifests_read": f"WITH {projects} SELECT * FROM p",
        "imports_by_project": f"""WITH {projects}, i AS ({IMPORTS}),
          m AS (SELECT i.*, p.project, p.prefix FROM i LEFT JOIN p ON p.language = i.language AND p.prefix IS NOT NULL AND starts_with(i.path, p.project || '/') QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(p.project) DESC) = 1),
          o AS (SELECT *, CASE WHEN starts_with(module, '.') THEN 'relative' WHEN starts_with(module, 'node:') THEN 'node' WHEN starts_with(module, coalesce(prefix, '?')) OR starts_with(module, '@acme/') THEN 'internal' ELSE 'external' END AS origin FROM m)
          SELECT id, module, name, project, origin, CASE WHEN origin IN ('relative', 'internal') THEN './mod_' || {h('module')} || CASE WHEN module LIKE '%.js' THEN '.js' ELSE '' END END AS module_mask, CASE WHEN origin IN ('relative', 'internal') THEN 'Import_' || {h('name')} END AS name_mask FROM o""",
        "incidents_sunk": "SELECT event_id AS id, event_type AS site_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
    }

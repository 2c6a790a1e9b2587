"""Stand-ins for names of tables, schemas, columns and aliases, and for literals, that keep what a name does and not what it is about.

A scope is what shares its secrets: a statement, a project.  Words of its tables, schemas and protected columns that are no
general vocabulary are its concepts; columns and aliases that hold a concept are masked too.  All is in column functions and
joins: a name meets its scope's concepts at once where they are at most `FEW`, and else by their first letters, so neither a
scope's names nor more of its concepts are gathered.  What several branches need is written once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.text import bound, short_hash
from veilmark.operators.config import ScanConfig
from veilmark.operators.detect import scan
from veilmark.operators.shared import written
from veilmark.operators.transform import swap_table, swapped

# Prefixes and nouns of table names, endings of column names, columns and words that say nothing of a company.
TABLE_PREFIXES = ("fact", "fct", "dim", "mart", "stg", "int", "raw", "ref", "ods", "bridge", "snap")
ENTITY_NOUNS = (
    "postings", "listings", "locations", "orders", "users", "customers", "accounts", "products", "events", "sessions", "transactions", "items",
    "invoices", "payments", "shipments", "reviews", "messages", "candidates", "applications", "subscriptions", "companies", "stores", "sales",
)
COLUMN_SUFFIXES = ("id", "at", "ts", "date", "time", "score", "rate", "probability", "amount", "count", "total", "pct", "ratio", "flag", "num", "min", "max", "avg", "sum", "key", "code", "status", "type")
GENERIC_COLUMNS = (
    "id", "created_at", "updated_at", "deleted_at", "created", "updated", "status", "type", "name", "email", "phone", "address", "city", "state",
    "country", "zip", "url", "description", "title", "count", "total", "amount", "date", "time", "timestamp", "uuid", "slug",
)
STOP_WORDS = (
    "index", "table", "data", "temp", "tmp", "view", "test", "prod", "dev", "main", "base", "src", "val", "key", "info", "meta", "map", "list", "set",
    "log", "row", "col", "analytics", "warehouse", "reporting", "staging", "public", "dwh", "dbt", "report", "summary", "detail",
    "user", "account", "order", "item", "event", "product", "customer", "company", "job", "person", "group", "role", "team", "org", "unit", "sale",
)

FEW = 64  # so many concepts of a scope at most are gathered into one row


@dataclass(frozen=True)
class NameConfig:
    """Vocabularies and knobs.  `columns` and `column_patterns` are protected whatever they hold; `blocked` and `value_patterns`
    are substrings and patterns of literals that are hidden whole."""

    salt: str = ""
    prefixes: tuple[str, ...] = TABLE_PREFIXES
    nouns: tuple[str, ...] = ENTITY_NOUNS
    suffixes: tuple[str, ...] = COLUMN_SUFFIXES
    generic_columns: tuple[str, ...] = GENERIC_COLUMNS
    stop_words: tuple[str, ...] = STOP_WORDS
    columns: tuple[str, ...] = ()
    column_patterns: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    value_patterns: tuple[str, ...] = ()
    least_word: int = 4
    hash_length: int = 6
    table_word: str = "tbl"
    schema_word: str = "schema"
    marker: str = "veilmark"

    def hashed(self, s: Column) -> Column:
        return short_hash(s, self.salt, self.hash_length)


def name_words(name: Column) -> Column:
    """The lower-case words of a snake_case or camelCase name."""
    parted = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(parted), r"[_\s]+"), lambda w: w != "")


def concept_words(name: Column, config: NameConfig) -> Column:
    """Those words of a name that are long enough and no general vocabulary."""
    parted = [re.sub("([a-z0-9])([A-Z])", r"\1_\2", c).lower() for c in config.generic_columns]
    general = {*config.prefixes, *config.nouns, *config.suffixes, *config.stop_words, *(w for c in parted for w in re.split(r"[_\s]+", c))}
    return F.array_distinct(F.filter(name_words(name), lambda w: (F.length(w) >= config.least_word) & ~w.isin(*sorted(general))))


def mask_table(name: Column, config: NameConfig) -> Column:
    """A known prefix and a known last noun stay, the hash follows: mart_acme_orders gives mart_orders_HASH."""
    def shaped(words: Column) -> Column:
        first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
        prefix = F.when(first.isin(*config.prefixes), first)
        noun = F.when(last.isin(*config.nouns) & ~last.eqNullSafe(prefix), last)
        return F.when(prefix.isNull() & noun.isNull(), F.lit(config.table_word)).otherwise(F.concat_ws("_", prefix, noun))

    return F.concat_ws("_", bound(name_words(name), shaped), config.hashed(name))


def mask_schema(name: Column, config: NameConfig) -> Column:
    return F.concat(F.lit(config.schema_word + "_"), config.hashed(name))


def mask_column(name: Column, config: NameConfig) -> Column:
    """A known last word stays: acme_rate gives HASH_rate."""
    put = lambda last: F.when(last.isin(*config.suffixes), F.concat_ws("_", config.hashed(name), last)).otherwise(F.concat(F.lit("col_"), config.hashed(name)))
    return bound(F.try_element_at(name_words(name), F.lit(-1)), put)


def mask_alias(name: Column, concepts: Column, config: NameConfig) -> Column:
    """Each of the `concepts` in the name, in any case and the longest first, becomes c and its hash; a name without any is hashed."""
    ordered = F.array_sort(F.transform(concepts, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("word"))))
    literally = lambda w: F.concat(F.lit(r"(?iu)\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    out = F.aggregate(ordered, name, lambda s, c: F.regexp_replace(s, literally(c["word"]), F.concat(F.lit("c"), config.hashed(c["word"]))))
    return bound(out, lambda new: F.when(new == name, F.concat(F.lit("alias_"), config.hashed(name))).otherwise(new))


def echoes(name: Column, concepts: Column) -> Column:
    """Whether a name holds one of the concepts, in any case."""
    return F.exists(concepts, lambda c: (c != "") & F.contains(F.lower(name), c))


def is_protected(column: Column, config: NameConfig) -> Column:
    """Whether a column's name is one that the configuration lists or describes."""
    return reduce(Column.__or__, [column.rlike(p) for p in config.column_patterns], column.isin(*config.columns) if config.columns else F.lit(False))


def _echoed(names: DataFrame, concepts: DataFrame, config: NameConfig) -> DataFrame:
    """Of `names` (scope, kind, name), those that hold some of `concepts` (scope, concept) of their scope, with the array of them.

    Scopes with at most FEW concepts hand all of them to each of their names.  In others a concept's first letters are looked up among
    all runs of as many letters of the name, so the join's rows grow with the names' lengths; what a name holds is bounded by its length.
    """
    low, n = F.lower("name"), config.least_word
    sizes = concepts.groupBy("scope").agg(F.count("concept").alias("size"))
    few = concepts.join(sizes.where(F.col("size") <= FEW), "scope").groupBy("scope").agg(F.collect_set("concept").alias("all"))
    held = F.filter("all", lambda c: F.contains(low, c))
    out = names.join(few, "scope").select("scope", "kind", "name", held.alias("concepts")).where(F.size("concepts") > 0)
    many = sizes.where(F.col("size") > FEW).select("scope")
    if many.isEmpty():
        return out
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda at: F.substring(low, at, F.lit(n))))
    cut = names.join(many, "scope", "left_semi").where(F.length(low) >= n).withColumn("run", F.explode(runs))
    keyed = concepts.join(many, "scope", "left_semi").select("scope", "concept", F.substring("concept", 1, n).alias("run"))
    met = cut.join(keyed, ["scope", "run"]).where(F.contains(low, F.col("concept")))
    return out.unionByName(met.groupBy("scope", "kind", "name").agg(F.collect_set("concept").alias("concepts")))


def name_masks(names: DataFrame, config: NameConfig) -> DataFrame:
    """Of `names` (scope, kind, name): scope, kind, name, mask, one row for each distinct name of a kind; the mask is null where
    the name stays.

    Kinds: table, schema, column, alias (names of common table expressions too).  Rows of other kinds and null scopes or names
    are left out.  An empty table gives no rows.  Names and concepts are worked out when this is called.
    """
    name, kind = F.col("name"), F.col("kind")
    rows = names.select("scope", "kind", "name").where("scope is not null and name is not null and kind in ('table', 'schema', 'column', 'alias')").distinct()
    protected = is_protected(name, config)
    general = name.isin(*config.generic_columns) if config.generic_columns else F.lit(False)
    rows = written(rows.withColumns({"found": kind.isin("table", "schema") | ((kind == "column") & protected), "stays": (kind == "column") & general}))
    words = lambda df: df.select("scope", F.explode(concept_words(name, config)).alias("concept")).distinct()
    concepts = written(words(rows.where("found")))
    named = rows.where("not found and not stays").select("scope", "kind", "name")
    columns = written(_echoed(named.where("kind = 'column'"), concepts, config))
    every = concepts.unionByName(words(columns)).distinct()
    aliases = _echoed(named.where("kind = 'alias'"), written(every), config)
    own = F.when(kind == "table", mask_table(name, config)).when(kind == "schema", mask_schema(name, config)).otherwise(mask_column(name, config))
    hits = columns.unionByName(aliases).withColumn("mask", F.when(kind == "alias", mask_alias(name, F.col("concepts"), config)).otherwise(mask_column(name, config)))
    rest = rows.where("not found").select("scope", "kind", "name").join(hits.drop("concepts"), ["scope", "kind", "name"], "left")
    return rows.where("found").select("scope", "kind", "name", own.alias("mask")).unionByName(rest)


def mask_literal(value: Column, config: NameConfig) -> Column:
    """A literal that holds a blocked text or matches a pattern, hidden whole; null for all others."""
    blocked = reduce(Column.__or__, [F.contains(F.lower(value), F.lit(b.lower())) for b in config.blocked if b], F.lit(False))
    matches = reduce(Column.__or__, [value.rlike(p) for p in config.value_patterns], F.lit(False))
    named = lambda kind: F.concat(F.lit(f"{config.marker}_{kind}_"), config.hashed(value))
    return F.when(blocked, named("blocked")).when(matches, named("redacted"))


def scrub_literals(values: DataFrame, config: NameConfig, scan_config: ScanConfig | None = None) -> DataFrame:
    """Of `values` (value): value, mask, mocks, one row for each distinct literal that changes; `mocks` are the (mock, real) pairs
    that bring it back.

    A literal that isn't hidden whole has the secrets in it replaced, each read without what stands around the literal.  Null and
    empty literals stay.
    """
    rows = values.select("value").where("value <> ''").distinct().withColumn("mask", mask_literal(F.col("value"), config))
    whole = rows.where("mask is not null").withColumn("mocks", F.array(F.struct(F.col("mask").alias("mock"), F.col("value").alias("real"))))
    rest = rows.where("mask is null").select("value")
    found = scan(rest, "value", "value", scan_config)
    parts = swapped(rest, "value", "value", found, swap_table(found, config.salt, scan_config)).where("swapped <> text")
    return whole.unionByName(parts.select(F.col("text").alias("value"), F.col("swapped").alias("mask"), "mocks"))

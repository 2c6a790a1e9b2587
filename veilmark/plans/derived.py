"""Tables of a folder, and rows derived from them by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, source: str, sql: str) -> DataFrame:
    table(spark, sf_dir, source).createOrReplaceTempView(f"veilmark_{source}")
    return spark.sql(re.sub(rf"FROM {source}\b", f"FROM veilmark_{source}", sql.replace("chr(10)", "char(10)")))


def fnv1a_sql(x: str) -> str:
    """32-bit FNV-1a over the characters' codes."""
    return f"list_reduce(list_prepend(2166136261, list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def tag_sql(x: str, length: int) -> str:
    """The base-36 digits of a stand-in for the value `x` with the salt of the queries; at most 14."""
    first = f"lower(to_base({fnv1a_sql(f'({x} || $$::salt$$)')}, 36, 7))"
    second = f"lower(to_base({fnv1a_sql(f'({first} || {x} || $$::salt$$)')}, 36, 7))"
    return f"left({first}{f' || {second}' if length > 7 else ''}, {length})"

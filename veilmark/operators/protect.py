"""Whole texts made safe to send: environment blocks masked, then secrets swapped, each distinct text worked on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.operators.config import ScanConfig
from veilmark.operators.detect import scan
from veilmark.operators.envfile import env_blocks_masked
from veilmark.operators.shared import written
from veilmark.operators.transform import swap_table, swapped


def by_content(df: DataFrame, key: str, text: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` done on the distinct texts of `df` as (content, text), `content` being their SHA-256, and joined to the keys as id.

    `work` returns content and its own columns.  Rows with null texts are left out.  A text that very many rows share is one
    row on one side of the last join, so adaptive execution can divide the other side.
    """
    rows = df.select(F.col(key).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("content"), F.col(text).alias("text")).where("text is not null")
    done = work(rows.groupBy("content").agg(F.first("text").alias("text")))
    return rows.select("id", "content").join(done, "content").drop("content")


def untouched(text: Column, salt: str, config: ScanConfig) -> Column:
    """blocks, masked, mocks of a text whose environment blocks stay."""
    return F.struct(F.lit(0).alias("blocks"), text.alias("masked"), F.array().cast("array<struct<mock:string,real:string>>").alias("mocks"))


def protect(df: DataFrame, key: str, text: str, salt: str, config: ScanConfig | None = None, on_detect: str = "mask", env_blocks: bool = True) -> DataFrame:
    """(id, masked, mocks, env_blocks, n_secrets, leaked, blocked), one row for each row of `df` whose text isn't null.

    Environment files and fenced blocks of that kind are masked first; the scan then runs over what that left, and what is a
    stand-in already stays.  `mocks` bring the text back.  `leaked` tells whether a value that has a stand-in is still there.
    Without `env_blocks` only the scan runs.  With on_detect "block" a text with a secret is `blocked` and `masked` is null.  Empty texts stay; keys may repeat.
    """
    if on_detect not in ("mask", "block"):
        raise ValueError("on_detect is mask or block")
    config = config or ScanConfig()

    def work(texts: DataFrame) -> DataFrame:
        masked = env_blocks_masked if env_blocks else untouched
        env = texts.withColumn("e", masked(F.col("text"), salt, config)).select("content", F.col("e.blocks").alias("env_blocks"), F.col("e.masked").alias("text"), F.col("e.mocks").alias("env_mocks"))
        env = written(env)
        found = written(scan(env, "content", "text", config))
        out = swapped(env, "content", "text", found, swap_table(found, salt, config)).select(F.col("id").alias("content"), F.col("swapped").alias("masked"), F.col("mocks").alias("own"))
        done = env.select("content", "env_blocks", "env_mocks").join(out, "content").withColumn("mocks", F.array_distinct(F.concat("env_mocks", "own")))
        # short settings (`1`, `a`) turn up by chance
        leaked = F.exists("mocks", lambda m: (F.length(m["real"]) >= 4) & F.contains("masked", m["real"]))
        blocked = (F.size("own") > 0) & F.lit(on_detect == "block")
        return done.select("content", F.when(~blocked, F.col("masked")).alias("masked"), "mocks", "env_blocks", F.size("own").alias("n_secrets"), leaked.alias("leaked"), blocked.alias("blocked"))

    return by_content(df, key, text, work)

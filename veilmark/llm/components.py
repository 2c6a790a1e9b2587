"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.stages import cut


def components(edges: DataFrame) -> DataFrame:
    """Of `edges` (a, b): (node, component), component being the smallest node that can be reached; null ends are dropped.

    Large-star and small-star rounds: each hangs neighbours onto the smallest node around, until nothing moves.  Every step is
    a grouped minimum and a join, both of which Spark can split at a node with very many neighbours.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(links)
    while seen[0]:
        links = cut(_small_star(_large_star(links)))
        now = _state(links)
        if now == seen:
            break
        seen = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

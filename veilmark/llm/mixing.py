"""Mixing sources to target weights (numbered operator 3), in DataFrame functions only.

Efraimidis-Spirakis sampling: a document of quality weight w gets the key -ln(u)/w, where u in (0, 1) comes from the MD5
of its id.  A source's target of T words over documents of S words first takes every document floor(T/S) times (complete
epochs); the rest is filled in key order up to the last whole document that fits, and then by the one further document
whose size comes nearest to the words still missing, if that brings the source nearer to its target.

Prefix sums don't gather a source in one task: keys fall into `KEY_BUCKETS` ranges whose sums are added up first, and only
the one range of a source in which the target lies is sorted: at most 4/512 of a source's documents, whatever their weights.
"Reruns agree" holds where files are split alike: row numbers of repeated rows come from the partitions' order.

Nulls: a null text has 0 words and is never needed by a target; a null source is a source of its own, the last in order.
Rows that share an id, or have none, are separate rows: each has a written row number, and their MD5 is of the id and a hash
of the text, and of the row number too for all but the first of those that share both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.stages import cut

KEY_BUCKETS = 512
LEAST_WEIGHT = 0.25  # of quality; the largest is 1
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.25 and 1: less for texts with many symbol characters a word."""
    symbols = F.length(text) - F.length(F.translate(text, "#$%&*|!<>{}", ""))
    return F.coalesce(F.lit(LEAST_WEIGHT) + F.lit(1.0 - LEAST_WEIGHT) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1))), F.lit(LEAST_WEIGHT))


def uniform(identity: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of an MD5."""
    digits = F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit("null"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, share: float, weights: list[float], epochs: float) -> DataFrame:
    """`sizes` (source, words) to (source, words, target): min(epochs*words, level*weight), the level spending the budget.

    Handing the excess of a capped source to the others by weight, again and again, ends at this level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("words") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumns(
        {
            "budget": F.sum("words").over(everything) * float(share),
            "all_weight": F.sum("weight").over(everything),
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "used_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("all_weight") - F.col("used_weight")))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return levels.withColumn("final", level).select("source", "words", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(
    docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), epochs: float = 2.0, sized: DataFrame | None = None, carried: list[str] | None = None
) -> DataFrame:
    """Of `docs` (doc_id, text, source): row, doc_id, source, size, source_size, target, taken (words, repeats counted), copies.

    `sized` may hand in (row, doc_id, source, size, weight, u) already worked out and written, row being unique, and further
    columns, which `carried` names to have them returned.
    """
    rows = sized if sized is not None else sized_rows(docs)
    rows = rows.withColumn("key", -F.log("u") / F.col("weight"))
    # keys of weight w are exponential with rate w, so whatever the weights are no bucket gets more than 1 / LEAST_WEIGHT shares
    rows = rows.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-LEAST_WEIGHT * F.col("key"))) * KEY_BUCKETS).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("words")), share, list(weights), epochs)
    targets = targets.withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") + 1e-12)).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("words"), F.lit(0.0)))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumnRenamed("words", "bucket_words")
    held = targets.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target", "whole", "rest")
    placed = placed.join(held, placed["source"].eqNullSafe(held["of"])).drop("of").withColumnRenamed("source", "of")
    rows = rows.join(placed.withColumnRenamed("bucket", "in_bucket"), rows["source"].eqNullSafe(F.col("of")) & (rows["bucket"] == F.col("in_bucket"))).drop("of", "in_bucket")
    whole_bucket = F.col("before") + F.col("bucket_words") <= F.col("rest")
    edge = ~whole_bucket & (F.col("before") < F.col("rest"))
    running = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = rows.where(edge).withColumn("after", F.col("before") + F.sum("size").over(running))
    at_edge = at_edge.withColumn("picked", F.col("after") <= F.col("rest")).drop("after")
    others = rows.where(~edge).withColumn("picked", whole_bucket)
    picked = others.unionByName(at_edge)
    # one more document where it closes the gap best
    filled = picked.groupBy("source").agg(F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0)).alias("filled"), F.first("rest").alias("wanted"))
    filled = filled.select(F.col("source").alias("of"), (F.col("wanted") - F.col("filled")).alias("gap"))
    joined = picked.join(filled, picked["source"].eqNullSafe(filled["of"])).drop("of")
    miss = F.abs(F.col("size") - F.col("gap"))
    fits = ~F.col("picked") & (F.col("size") > 0) & (miss < F.col("gap"))
    best = joined.where(fits).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "key", "doc_id", "row")).alias("best"))
    best = best.select(F.col("source").alias("of"), F.col("best.row").alias("extra"))
    joined = joined.join(best, joined["source"].eqNullSafe(best["of"]), "left").drop("of")
    again = F.col("picked") | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))
    copies = (F.col("whole") + again.cast("int")).alias("copies")
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + again.cast("int"))).cast("long").alias("taken"), copies, *(carried or []))


def sized_rows(docs: DataFrame, carried: list[Column] | None = None) -> DataFrame:
    """What the sampling needs of each row, without its text, and the columns `carried`, written with a row number."""
    size, more = word_count(F.col("text")), carried or []
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    content = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), quality_weight(F.col("text"), size).alias("weight"), name.alias("name"), F.xxhash64("text").alias("hash"), *more)
    rows = cut(content)  # texts are read once
    same = rows.groupBy("name", "hash").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = same.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
    repeated = same.join(shared, "name").select("name", "hash", "first")
    of_text = F.concat_ws("/", "name", F.col("hash").cast("string"))
    own = F.when(F.col("first").isNull(), F.col("name")).when(F.col("first") == F.col("row"), of_text).otherwise(F.concat_ws("/", of_text, F.col("row").cast("string")))
    return cut(rows.join(repeated, ["name", "hash"], "left").withColumn("u", uniform(own)).drop("name", "hash", "first"))

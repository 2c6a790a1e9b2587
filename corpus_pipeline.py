"""A training corpus from documents: toxicity, quality, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read again for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.components import components
from veilmark.llm.mixing import mix_sources, sized_rows
from veilmark.llm.ngramjoin import link_classes
from veilmark.llm.packing import pack_documents
from veilmark.llm.quality import fit_quality, score_quality_rows
from veilmark.llm.stages import content_key, cut, one_of_each, shared_folder
from veilmark.llm.toxicity import fit_toxicity, score_toxicity_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return score_toxicity_rows(docs, fit_toxicity(docs, labels)).where("score < 0.5").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer takes for junk go."""
    return score_quality_rows(docs, fit_quality(docs)).where("score >= 0.5").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose five-word shingles are 80 % alike, the one with the smallest id stays, one with an id before one without.

    Rows are compared as rows, whatever their ids: different texts of one id all stay, copies without an id go.  Ties of ids
    go by a hash of the whole row.  A text without words is like no other.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    h1, h2 = content_key(docs.columns)
    found = link_classes(docs.where(worded).select(h1.alias("tag"), "doc_id", h1, h2, "text"), k=5, percent=80)
    member = components(found.edges)
    place = found.class_of.join(member, F.col("id") == F.col("node"), "left").select("digest", "salt", F.coalesce("component", "id").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h1", "_h2")
    first = cut(found.rows.join(place, ["digest", "salt"]).groupBy("component").agg(F.min(order).alias("first")).select("first._h1", "first._h2"))
    kept = one_of_each(docs.where(worded)).join(first, ["_h1", "_h2"], "left_semi").select(docs.columns)
    return kept.unionByName(docs.where(~worded))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rows that share an id each by itself; rows without an id once.

    Of equal rows one is read and repeated; a row of very many copies is repeated by several tasks.
    """
    named = docs.where("doc_id is not null")
    mixed = mix_sources(named, sized=sized_rows(named, content_key(docs.columns)), carried=["_h1", "_h2"])
    lots = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / LOT)))
    copies = cut(mixed.where("copies > 0").groupBy("_h1", "_h2").agg(F.sum("copies").alias("_copies")).withColumn("_lot", lots))
    rows = one_of_each(named).join(copies, ["_h1", "_h2"])
    few = rows.where(F.col("_copies") <= LOT)
    many = rows.where(F.col("_copies") > LOT).repartition("_h1", "_h2", "_lot")
    times = F.least(F.col("_copies") - F.col("_lot") * LOT, F.lit(LOT))
    repeated = [part.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(docs.columns) for part in (few, many)]
    return repeated[0].unionByName(repeated[1]).unionByName(docs.where("doc_id is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs)


LOT = 1000  # copies of one row that one task writes

STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: No SQL: trained classifiers, a tokenizer and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    home = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = f"{home}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

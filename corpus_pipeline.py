"""A training-data pipeline over ``documents``: toxic texts go, of exact and of
near copies one stays, sources are mixed to target weights, and what is left is
encoded.  Every stage's result is written to the shared folder and read again.

Rows that share doc_id and text are one document; rows of one doc_id with
different texts stay or go together in the near-duplicate stage, and those that
also agree in source and size take equally many copies in the mix.  No stage
needs a column but doc_id, text and source; others are carried along.  An empty
table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm import bpe, exact_dedup, mixing, simhash, toxicity
from geostrata.llm.common import free_name, load, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels, scores below 0.5."""
    p = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.scored(docs, p, out=score).where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    bare = F.translate(F.coalesce("text", F.lit("")), exact_dedup.SPACE, "")
    sha, rank = free_name(docs, "sha"), free_name(docs, "rank")
    mine = docs.withColumn(sha, F.unhex(F.sha2(bare, 256))).alias("x")
    on = F.col("x.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"x.{sha}") == F.col("k.digest"))
    # Of rows repeated under one doc_id the longest text stays, as the operator's rule has it.
    stay = mine.join(kept.alias("k"), on, "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        order = [F.length("text").desc_nulls_last(), F.xxhash64("text"), F.xxhash64(*docs.columns)]
        stay = stay.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(*order))).where(F.col(rank) == 1)
    return stay.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    near = simhash.near_duplicates(docs)
    stay = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct().alias("k")
    return docs.alias("x").join(stay, F.col("x.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    taken = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    size, copy = free_name(docs, "size"), free_name(docs, "copy")
    mine = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")).alias("x")
    on = F.col("x.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("x.source").eqNullSafe(F.col("t.source")) & (F.col(f"x.{size}") == F.col("t.size"))
    out = mine.join(taken.alias("t"), on).select(*[F.col(f"x.{c}").alias(c) for c in docs.columns], F.sequence(F.lit(1).cast("long"), "t.copies").alias(copy))
    return out.select(*docs.columns, F.explode(copy).alias(copy)).drop(copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, per copy."""
    return bpe.digest_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs


#: A trained network, fingerprints and random rounding are beyond SQL; tested by brute force.
ORACLE_SQL = None

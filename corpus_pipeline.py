"""The corpus pipeline: quality rules, line deduplication, near duplicates, mixing, token codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.llm import bpe, jaccard_join, line_dedup, quality_rules, source_mix
from citesieve.llm.common import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs proven on labelled documents."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one has; those left without lines go."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    mixed = source_mix.mix_sources(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"), ["row"])
    return mixed.where("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "row").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    vocabulary = bpe.public_vocabulary()
    decoded = bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary)
    return decoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: The line alignment, the knapsack and the token merges have no SQL form; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

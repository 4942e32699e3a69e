"""What the training-data operators share: words, case folding, stage tables, components of links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = "[ \\t-\\r]+"


def fold_case(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without a blank character. Null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); local sessions may go without."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends here, so lost executors repeat nothing before it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links`` (a, b: bigint): one row (node, root) per node, root the smallest node it reaches.

    Alternates the two star operations: every node's larger neighbours move to its smallest
    neighbour, then its smaller ones do. The smallest neighbour is an aggregate joined back, never a
    list, so a hub costs no task more than its share (the join is between stage tables, which
    adaptive execution splits). The number of rounds grows with the square of the logarithm at worst.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low")), name)
        large = stage(both.join(low, F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                      .where("a <> b").distinct(), name)
        low = stage(large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node"), name)
        joined = large.join(low, F.col("a") == F.col("node"))
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                                F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = stage(small.where("a <> b").distinct(), name)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node a has one neighbour b, which is no a itself: then the components are found."""
    owners = edges.groupBy("a").agg(F.count("*").alias("n"))
    if owners.where("n > 1").limit(1).count():
        return False
    return not edges.join(owners.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()

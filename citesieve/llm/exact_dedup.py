"""Exact deduplication by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.llm.common import fold_case, stage

BLOCK_BYTES = 8192


def block_digest(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Give every row of a hash-partitioned distinct table an integer: its place after a sort.

    The sort makes the names of a partition repeatable when a lost task runs again.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_texts(documents: DataFrame, block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = block_digest) -> tuple[DataFrame, DataFrame]:
    """Name every row of ``documents`` (doc_id, text) by its normalised text: equal texts, and only they, share (level, name).

    Returns the rows (rid, doc_id, n_blocks, text_sha256) and the names (rid, level, name).

    Texts (null: empty; A-Z lower-cased) are cut into blocks of ``block_bytes`` bytes. Distinct
    blocks are sorted into integer names; then adjacent names are paired, distinct pairs are sorted
    into names, and so on until a document has one name. Texts of equal length end at the same level
    and names are injective on each level, so there are no collisions. The digest of a block only
    carries its name back to the documents without moving the text a second time. Should two
    different blocks have one digest, the names are joined by the blocks themselves.
    """
    folded = F.encode(fold_case(F.col("text")), "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes))).cast("int")
    base = documents.select(F.col("doc_id"), folded.alias("bytes"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = stage(base.withColumn("n_blocks", count).withColumn("blocks", cut).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "n_blocks", F.sha2("bytes", 256).alias("text_sha256"),
        F.transform("blocks", digest).alias("digests")), "dedup-rows")
    blocks = base.withColumn("n_blocks", count).select(F.explode(cut).alias("block")).select(digest(F.col("block")).alias("digest"), "block")
    named = _named(blocks.distinct(), ["digest", "block"])
    names = stage(named.select("digest", "name"), "dedup-names")
    placed = rows.select("rid", "n_blocks", F.posexplode("digests").alias("ix", "digest"))
    if names.groupBy("digest").count().where("count > 1").limit(1).count():
        names = stage(named.select("block", "name"), "dedup-names")
        rows = stage(base.withColumn("n_blocks", count).select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "n_blocks", F.sha2("bytes", 256).alias("text_sha256"), cut.alias("blocks")), "dedup-blocks")
        whole = rows.select("rid", "n_blocks", F.posexplode("blocks").alias("ix", "block"))
        level_rows = whole.join(names, "block").select("rid", "n_blocks", "ix", "name")
    else:
        level_rows = placed.join(names, "digest").select("rid", "n_blocks", "ix", "name")
    most = rows.agg(F.max("n_blocks")).first()[0] or 1
    found, level = [], 0
    while True:
        if 2 ** level < most:
            level_rows = stage(level_rows, "dedup-level")
        found.append(level_rows.where(F.col("n_blocks") <= 2 ** level).select("rid", F.lit(level).alias("level"), "name"))
        if 2 ** level >= most:
            break
        longer = level_rows.where(F.col("n_blocks") > 2 ** level)
        pairs = stage(longer.groupBy("rid", "n_blocks", F.floor(F.col("ix") / 2).cast("int").alias("ix")).agg(
            F.max(F.when(F.col("ix") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("ix") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")), "dedup-pairs")
        pair_names = stage(_named(pairs.select("left", "right").distinct(), ["left", "right"]), "dedup-pair-names")
        level_rows = pairs.join(pair_names, ["left", "right"]).select("rid", "n_blocks", "ix", "name")
        level += 1
    names_of = found[0]
    for part in found[1:]:
        names_of = names_of.union(part)
    return rows.select("rid", "doc_id", "n_blocks", "text_sha256"), names_of


def exact_dedup(documents: DataFrame, block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = block_digest) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids lose to any other; of repeated
    rows with the same id exactly one is kept). Null and empty texts are equal to each other. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows, names = name_texts(documents.select("doc_id", "text"), block_bytes, digest)
    placed = stage(rows.drop("n_blocks").join(names, "rid"), "dedup-placed")
    groups = stage(placed.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("last"), F.count("*").alias("group_size")), "dedup-groups")
    return placed.join(groups, ["level", "name"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"), "text_sha256")

"""Ordered computations (suffix sums, previous row, dense index) that never sort a whole key in one task.

A plain window over a key puts every row of the key in one task. When a key can hold a large
share of the table that task is the job. Each helper cuts the key into ordered buckets, works
inside ``(key, bucket)``, and carries one summary row per bucket across; the summaries are
bounded by the number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffix_sums(df: DataFrame, keys: list[str], value: str, bucket: Column, sums: dict[str, str]) -> DataFrame:
    """For each row: totals over rows of the key with the same or a larger ``value``, and the next larger value.

    ``sums`` maps input columns to output columns. ``value`` must be unique inside a key
    (pre-aggregate first) and ``bucket`` must be monotone in it. Adds ``next_<value>``.
    """
    part = df.withColumn("_bucket", bucket)
    per_bucket = part.groupBy(*keys, "_bucket").agg(
        F.min(value).alias("_low"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    above = Window.partitionBy(*keys).orderBy(F.desc("_bucket"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys, "_bucket", F.lag("_low").over(above).alias("_next_low"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_carry_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(value))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = part.select("*", F.lag(value).over(inside).alias("_next"),
                        *[F.sum(c).over(running).alias(f"_run_{c}") for c in sums])
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.select(
        *df.columns, F.coalesce("_next", "_next_low").alias(f"next_{value}"),
        *[(F.col(f"_run_{c}") + F.col(f"_carry_{c}")).alias(out) for c, out in sums.items()])


def last_before(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its key, in ``order``.

    ``bucket`` must be monotone in the order columns (for events: the hour).
    """
    part = df.withColumn("_bucket", bucket).withColumn("_value", value)
    position = F.struct(*order)
    per_bucket = part.groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), position)).alias("_latest"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "_bucket", F.last("_latest", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return (local.join(carried, [*keys, "_bucket"])
            .select(*df.columns, F.coalesce("_inside", "_carried").alias(out)))


def dense_index(df: DataFrame, keys: list[str], identity: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Number the rows of each key 0..n-1 in a repeatable order, without one task per key. Adds ``<out>_size``."""
    part = df.withColumn("_bucket", F.pmod(F.xxhash64(*identity), F.lit(buckets)))
    counts = part.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(per_key).alias(f"{out}_size"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*identity)
    local = part.withColumn("_position", F.row_number().over(inside) - 1)
    return (local.join(offsets, [*keys, "_bucket"])
            .select(*df.columns, (F.col("_position") + F.col("_offset")).alias(out), f"{out}_size"))


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column, out: str,
               inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` along ``order`` inside each key; ``bucket`` is a column monotone in the order."""
    part = df.withColumn("_value", value)
    totals = part.groupBy(*keys, bucket).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = part.withColumn("_run", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return local.join(carried, [*keys, bucket]).select(*df.columns, (F.col("_run") + F.col("_carry")).alias(out))


def bucketed_rank(df: DataFrame, keys: list[str], score: str, ties: list[str], bucket: Column, out: str) -> DataFrame:
    """Rank 1..n of every row of a key by ``score`` descending, then ``ties``; ``bucket`` is monotone in the score."""
    part = df.withColumn("_bucket", bucket)
    counts = part.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(score), *ties)
    local = part.withColumn("_position", F.row_number().over(inside))
    return local.join(offsets, [*keys, "_bucket"]).select(*df.columns, (F.col("_position") + F.col("_offset")).cast("int").alias(out))
